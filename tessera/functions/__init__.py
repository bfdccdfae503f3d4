"""Column functions: exact rounding, quantiles, rescaling, seeded draws, labels."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed, stream and keys only, not on partitions."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, stream: str, *keys: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    u, v = uniform(seed, stream + "u", *keys), uniform(seed, stream + "v", *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(3.141592653589793) * v)


def half_even(c: Column) -> Column:
    """Rounds to the nearest whole number, halves to the even one."""
    return F.bround(c, 0).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def between(c: Column, least: Column, most: Column, low: float, high: float) -> Column:
    """Linear map of the range least..most onto (low, high), reversed if low > high; a single value goes to the middle."""
    return F.when(most == least, F.lit((low + high) / 2)).otherwise(F.lit(low) + F.try_divide(c - least, most - least) * F.lit(high - low))


def rescale(c: Column, low: float, high: float, over: WindowSpec) -> Column:
    """The map of the range within the window."""
    return between(c, F.min(c).over(over), F.max(c).over(over), low, high)


def standard(c: Column, mean: Column, sd: Column) -> Column:
    """Distance from the mean in standard deviations; null where these are 0."""
    return F.try_divide(c - mean, sd)


def zscore(c: Column, over: WindowSpec) -> Column:
    """Distance from the mean of the window in its sample standard deviations."""
    return standard(c, F.avg(c).over(over), F.stddev_samp(c).over(over))


def rank_label(rank: Column, most: int, prefix: str = "cells_", rest: str = "noise") -> Column:
    """1, 2, ... as cells_a, cells_b, ... up to `most` (26 at most), then the rest label."""
    if not 1 <= most <= 26:
        raise ValueError("from 1 to 26 labels have letters")
    return F.when(rank <= most, F.concat(F.lit(prefix), F.chr(F.lit(96) + rank))).otherwise(F.lit(rest))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
