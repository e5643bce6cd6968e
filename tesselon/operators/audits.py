"""Audits: what should be zero, counted; and differences between two states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leakage(observed: DataFrame, splits: DataFrame) -> DataFrame:
    """(object_type, id, splits, split_key) of objects seen in windows of more than one split."""
    seen = observed.join(splits, ["col", "row"]).groupBy("object_type", "id").agg(F.collect_set("split").alias("s"))
    return seen.filter(F.size("s") > 1).select("object_type", "id", F.size("s").cast("long").alias("splits"), F.array_join(F.array_sort("s"), "|").alias("split_key"))


def split_mapping_audit(mapping: DataFrame, splits: DataFrame) -> DataFrame:
    """(rows, unknown, mismatched, duplicates) of a window-district mapping against the windows' splits."""
    known = splits.select("col", "row", F.col("split").alias("expected"))
    keyed = mapping.groupBy("col", "row", "district", "split").agg(F.count("*").alias("n")).join(known, ["col", "row"], "left")
    n = F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return keyed.agg(F.coalesce(F.sum(n), F.lit(0)).alias("rows"), total(F.col("expected").isNull()).alias("unknown"), total(F.col("expected") != F.col("split")).alias("mismatched"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): keys added, removed or changed, and the fields that differ, null being equal to null."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias("key"), change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("fields")).filter("change IS NOT NULL")


def lineage_diff(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(bucket, missing, extra, different) by the first two characters of the identity."""
    text = lambda: F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("<NA>")) for f in fields))
    a, b = expected.select(F.col(key).alias("k"), text().alias("l")), found.select(F.col(key).alias("k"), text().alias("r"))
    return a.join(b, "k", "full_outer").groupBy(F.substring("k", 1, 2).alias("bucket")).agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"), F.count_if(F.col("l") != F.col("r")).alias("different"))


def cross_split_overlaps(splits: DataFrame) -> DataFrame:
    """(split_a, split_b, pairs) of windows of different splits that share area: those whose indices differ by less than 2 each way."""
    near = splits.select(F.col("col").alias("c"), F.col("row").alias("r"), F.col("split").alias("split_a"), F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col"), "row")
    near = near.select("c", "r", "split_a", "col", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"))
    pairs = near.join(splits.withColumnRenamed("split", "split_b"), ["col", "row"]).filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("pairs"))


def identity_audit(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, rows, null_ids, bad_format, duplicate_ids)."""
    ids = df.groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("v")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return ids.groupBy(by).agg(F.sum("n").alias("rows"), total(v.isNull()).alias("null_ids"), total(~v.rlike("^[0-9a-f]{64}$")).alias("bad_format"), F.count_if(v.isNotNull() & (n > 1)).alias("duplicate_ids"))


def embedding_quality(df: DataFrame, vector: str, by: str, width: int) -> DataFrame:
    """(by, rows, wrong_width, non_finite, zero) of vectors."""
    v = F.col(vector)
    return df.groupBy(by).agg(
        F.count("*").alias("rows"), F.count_if(F.size(v) != width).alias("wrong_width"), F.count_if(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("non_finite"), F.count_if(F.forall(v, lambda x: x == 0)).alias("zero"),
    )


def select_windows(windows: DataFrame, n: int) -> DataFrame:
    """The first n windows of each split by column and row."""
    return windows.withColumn("rank", F.row_number().over(Window.partitionBy("split").orderBy("col", "row")).cast("long")).filter(F.col("rank") <= n)


def shard_plan(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds shard: rows numbered within ``by`` in order, in shards of ``size``."""
    return df.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))


def radial_bands(df: DataFrame, x: str, y: str, code: str, bands: int = 3) -> DataFrame:
    """Adds band (from 0): equally many rows a band by distance from the mean place, then code. For tables of few rows, such as districts."""
    centre = df.agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    placed = df.crossJoin(centre).withColumn("distance", F.round(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")), 6)).drop("_x", "_y")
    return placed.withColumn("band", (F.ntile(bands).over(Window.orderBy("distance", code)) - 1).cast("long"))
