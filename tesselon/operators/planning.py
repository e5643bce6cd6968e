"""Plans and verdicts: weighted tasks, stratified samples, partition parity, metric tables and rules over them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def weighted_tasks(costs: list[tuple[str, float]], most: int = 240) -> dict[str, int]:
    """Task of each named cost: greatest first, ties by name, each to the least loaded task. A plan for the driver; Spark itself needs none."""
    bins = [(0.0, k) for k in range(max(1, min(most, len(costs))))]
    out = {}
    for name, cost in sorted(costs, key=lambda c: (-c[1], c[0])):
        load, k = heapq.heappop(bins)
        out[name] = k
        heapq.heappush(bins, (load + cost, k))
    return out


def stratified_sample(df: DataFrame, stratum: str, order: list[str], n: int = 25) -> DataFrame:
    """The first n rows of each stratum in order."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def row_ranges(rows: int, size: int = 512) -> list[tuple[int, int]]:
    """[first, last) of tasks of ``size`` rows."""
    return [(k, min(k + size, rows)) for k in range(0, rows, size)]


def partition_parity(df: DataFrame, columns: list[str], partitions: int) -> bool:
    """Whether a frame's content is the same however it is split."""
    hashes = {ids.content_hash(df.repartition(n), ["parity"], columns).first()["content_hash"] for n in (1, partitions)}
    return len(hashes) == 1


def melt(df: DataFrame) -> DataFrame:
    """(metric, value) of a frame of one row of numbers."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns))).alias("m")).select("m.*")


def expect(metrics: DataFrame, expected: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """(metric, value, expected, ok); a metric that isn't named is expected to be 0, one that is missing fails."""
    named = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v))))) if expected else F.lit(None).cast("map<string,double>")
    present = metrics.withColumn("expected", F.coalesce(named[F.col("metric")], F.lit(0.0)))
    checked = present.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False)))
    lost = metrics.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "metric string, expected double").join(metrics.select("metric"), "metric", "left_anti")
    return checked.unionByName(lost.select("metric", F.lit(None).cast("double").alias("value"), "expected", F.lit(False).alias("ok")))


def assess(metrics: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(code, severity, metric, value) of each rule (code, severity, metric, condition on value) that holds."""
    hits = F.array_compact(F.array(*(F.when((F.col("metric") == m) & condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, m, condition in rules)))
    return metrics.withColumn("r", F.explode(hits)).select("r.code", "r.severity", "metric", "value")


def record_errors(record: dict[str, tuple[str, Column]]) -> Column:
    """Messages of the checks (name -> message, condition that must hold) that a row fails; a null condition fails."""
    return F.array_compact(F.array(*(F.when(F.coalesce(condition, F.lit(False)), F.lit(None)).otherwise(F.lit(f"{name}: {message}")) for name, (message, condition) in record.items())))
