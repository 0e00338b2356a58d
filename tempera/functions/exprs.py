"""Scalar expressions over points and clusters; all stay inside Spark's code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a cluster's squared scale follows from its centre (codes as in configuration files).
UNIT, FIXED, PROPORTIONAL, ANNEALED = 0, 1, 2, 3


def sigma2(y: Sequence[Column], method: int | Callable[[Sequence[Column]], list[Column]], params: Sequence[float] = ()) -> list[Column]:
    """Squared scales of a centre, one a dimension: all 1; fixed; proportional to the centre in the
    first dimension; or what a function gives for the centre's columns."""
    if callable(method):
        return list(method(y))
    if method == UNIT:
        return [F.lit(1.0) for _ in y]
    fixed = [F.lit(float(p) * float(p)) for p in params[: len(y)]]
    if method == FIXED:
        return fixed
    return [(F.lit(float(params[0])) * y[0]) * (F.lit(float(params[0])) * y[0]), *fixed[1:]]


def squared_distance(x: Sequence[Column], y: Sequence[Column], s2: Sequence[Column] | None = None) -> Column:
    """Sum of squared differences, each divided by its squared scale."""
    out = None
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        term = (a - b) * (a - b) / s2[i] if s2 else (a - b) * (a - b)
        out = term if out is None else out + term
    return out


def array_squared_distance(x: Column, y: Column) -> Column:
    """The same for array columns, unscaled."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def cluster_radius(width2: Column) -> Column:
    return F.sqrt(width2)


def bin_with_overflow(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bins 1 to n over [lo, hi]; 0 below and n + 1 above."""
    inner = F.least(F.floor((v - lo) * n / (hi - lo)).cast("int") + 1, F.lit(n))
    return F.when(v < lo, 0).when(v > hi, n + 1).otherwise(inner).cast("int")


def bin_clamped(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bins 0 to n - 1, of which the first and last take what lies outside."""
    at = F.floor((v - lo) * (n - 2) / (hi - lo)).cast("int") + 1
    return F.greatest(F.least(at, F.lit(n - 1)), F.lit(0)).cast("int")


def pretty_bin(size: Column) -> Column:
    """A bin size rounded up to two digits; as it is outside (1e-9, 1e10]."""
    scale = F.pow(F.lit(10.0), 1 - F.floor(F.log10(size)))
    return F.when((size <= 1e-9) | (size > 1e10), size).otherwise(F.ceil(F.least(scale * size, F.lit(100.0))) / scale)


def pretty_range(lo: Column, hi: Column, n: int) -> tuple[Column, Column]:
    """A range of n pretty bins: its start is rounded down to a multiple of the bin."""
    size = pretty_bin((hi - lo) / n)
    start = F.floor(lo / size) * size
    return start, start + n * pretty_bin((hi - start) / n)


def to_label(text: Column) -> Column:
    """A whole number; a real one is rounded down with a grace of 0.001; else null."""
    real = text.try_cast("double")
    return F.coalesce(text.try_cast("int"), F.floor(real + 0.001).cast("int"))


def padded(c: Column, width: int, left: bool = True) -> Column:
    """Pad with spaces, never cut."""
    text = c.cast("string")
    wide = F.greatest(F.length(text), F.lit(width))
    return (F.lpad if left else F.rpad)(text, wide, F.lit(" "))


def duration(ms: Column) -> Column:
    """Milliseconds as days, hours, minutes, seconds and milliseconds."""
    part = lambda size, of: (F.floor(ms / size) % of if of else F.floor(ms / size)).cast("int")
    return F.format_string("%dd:%02dH:%02dM:%02dS:%03dmS", part(86_400_000, 0), part(3_600_000, 24), part(60_000, 60), part(1000, 60), (ms % 1000).cast("int"))


def contains(start: Column, end: Column, v: Column) -> Column:
    return (v >= start) & (v <= end)


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common part of two inclusive ranges; null if there is none."""
    return F.when(intersects(a0, a1, b0, b1), F.struct(F.greatest(a0, b0).alias("start"), F.least(a1, b1).alias("end")))


def min_eigen_2x2(a: Column, b: Column, d: Column) -> Column:
    """Least eigenvalue of [[a, b], [b, d]] and its unit vector, as struct<value, v0, v1>."""
    value = (a + d - F.sqrt((a - d) * (a - d) + 4 * b * b)) * 0.5
    norm = F.sqrt(b * b + (d - value) * (d - value))
    return F.struct(value.alias("value"), (-b / norm).alias("v0"), ((d - value) / norm).alias("v1"))


def fixed(c: Column, places: int) -> Column:
    """A number as text with so many decimals, rounded as C's printf does: by the exact value of the double, not by the
    decimals that stand for it, as ``format_string`` would."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))
