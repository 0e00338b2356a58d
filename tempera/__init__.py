"""Annealed clustering, cluster analytics and corpus preparation on PySpark DataFrames."""
