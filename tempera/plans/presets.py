"""Settings of the usual ways to run, by mode number, over a given configuration."""

from __future__ import annotations

from dataclasses import replace

from tempera.sources.config import Config


def fresh_full_analysis(c: Config) -> Config:
    return c


def sponge_points(c: Config) -> Config:
    """Cluster the points that a former run left in its sponge."""
    return replace(c, InputFileType=1, SelectedInputLabel=0, CompareSolution=-1)


def join_equilibrate(c: Config) -> Config:
    """Go on from a former run at a low temperature, cooling at a quarter of the usual pace."""
    root = lambda x: x**0.25
    cooling = {k: root(getattr(c, k)) for k in ("InitialCoolingFactor1", "InitialCoolingFactor2", "FineCoolingFactor1", "FineCoolingFactor2")}
    return replace(c, RestartTemperature=0.025, Tminimum=0.005, CompareSolution=1, **cooling)


def change_sponge_factor(c: Config) -> Config:
    """The same while the sponge factor falls from 2 to 1 between the temperatures 5 and 2."""
    return replace(join_equilibrate(c), SpongeFactor1=2.0, SpongeFactor2=1.0, SpongeTemperature1=5.0, SpongeTemperature2=2.0)


def just_analyze(c: Config) -> Config:
    """No refinement, only comparison."""
    return replace(c, RestartTemperature=0.025, CompareSolution=1, IterationAtEnd=0)


PRESETS = {1: fresh_full_analysis, 2: sponge_points, 3: join_equilibrate, 4: change_sponge_factor, 5: just_analyze}


def preset(c: Config) -> Config:
    return PRESETS[c.LCMSmode](c).checked()


def basic_annealing(c: Config) -> Config:
    """Plain annealing of vectors: one scale, no sponge, up to 30 clusters, slow cooling."""
    slow = {"InitialCoolingFactor1": 0.995, "FineCoolingFactor1": 0.9995, "InitialCoolingFactor2": 0.995, "FineCoolingFactor2": 0.9995}
    return replace(
        c, UseSponge=False, SigmaMethod=0, MaxNcentTotal=30, TargetNcentPerPoint=30, MaxNcentPerPoint=30, InitialNcent=1, SelectedInputLabel=0, InputFileType=0, Replicate=1,
        ParameterVectorDimension=3, MagicTemperatures=(-1.0,) * 5, MaxNumberSplitClusters=4, WaitIterations=4, TooSmallToSplit=15.0, **slow,
    )


def basic_kmeans(c: Config) -> Config:
    """K-means of vectors with three clusters."""
    return replace(c, UseSponge=False, SigmaMethod=0, InitialNcent=3, MaxNcentTotal=3, TargetNcentPerPoint=3, MaxNcentPerPoint=3, SelectedInputLabel=0, ParameterVectorDimension=3)
