"""Statistics of cells by zone, and of zones by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import exact_quantiles, finite


def histogram(cells: DataFrame, zone: str, code: str) -> DataFrame:
    """(zone, codes): a map from class code to its number of cells. Counted before it is gathered."""
    counts = cells.filter(F.col(code).isNotNull()).groupBy(zone, code).agg(F.count("*").alias("n"))
    return counts.groupBy(zone).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(code), "n")))).alias("codes"))


def statistics(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, cells, min, q25, median, q75, max, mean, std) with the population's deviation."""
    v = F.col(value)
    held = cells.filter(finite(v))
    out = held.groupBy(zone).agg(F.count("*").alias("cells"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    quantiles = exact_quantiles(held.select(zone, value), [zone], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.join(quantiles, zone).select(zone, "cells", "min", "q25", "median", "q75", "max", "mean", "std")


def entropy(counts: Column) -> Column:
    """Shannon entropy, in nats, of a map of counts; 0 of an empty one."""
    values = F.map_values(counts)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def dense(counts: Column, keys: list[str]) -> Column:
    """A map's values under the given keys, 0 where it lacks one."""
    return F.transform(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.element_at(counts, k), F.lit(0)))


def pooled(zones: DataFrame, by: str, weight: str = "cells", mean: str = "mean", std: str = "std") -> DataFrame:
    """(by, zones, weight, mean, std) from the zones' own, deviations pooled over squares and never averaged."""
    w, m, s = F.col(weight), F.col(mean), F.col(std)
    sums = zones.groupBy(by).agg(F.count("*").alias("zones"), F.sum(w).alias("weight"), F.sum(w * m).alias("wm"), F.sum(w * (s * s + m * m)).alias("wq"))
    mu = F.col("wm") / F.col("weight")
    return sums.select(by, "zones", "weight", mu.alias("mean"), F.sqrt(F.greatest(F.col("wq") / F.col("weight") - mu * mu, F.lit(0.0))).alias("std"))
