"""Windows and cells of the plane: index arithmetic instead of range joins.

Window (col, row) is the closed square of side ``size`` whose centre is (col * stride, row * stride) from the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, STRIDE, BLOCK = 500, 250, 2000
#: Windows a side of a group: what one call of a kernel works out. The columns that name a row's group, where it has one.
GROUP, GROUPED = 10, ["_group_col", "_group_row"]
PART = 1 << 19


def lo(value: Column, size: float = SIZE, stride: float = STRIDE) -> Column:
    """Least index of a closed window that reaches a coordinate."""
    return F.ceil((value - size / 2) / stride).cast("long")


def hi(value: Column, size: float = SIZE, stride: float = STRIDE) -> Column:
    return F.floor((value + size / 2) / stride).cast("long")


def windows_of(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float = SIZE, stride: float = STRIDE) -> DataFrame:
    """A row for each window that a bounding box reaches, boundary included: adds col and row. No join, no shuffle.

    Rows of ``in_groups`` get the windows of their group."""
    out = df
    for name, group, a, b in (("col", GROUPED[0], x0, x1), ("row", GROUPED[1], y0, y1)):
        first, last = lo(a, size, stride), hi(b, size, stride)
        if group in df.columns:
            first, last = F.greatest(first, F.col(group) * GROUP), F.least(last, F.col(group) * GROUP + (GROUP - 1))
        out = out.withColumn(name, F.explode(F.sequence(first, last)))
    return out


def in_groups(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float = SIZE, stride: float = STRIDE, parts: int | None = None) -> DataFrame:
    """A row for each group of ``GROUP`` x ``GROUP`` windows that a bounding box reaches, partitioned by group.

    Rows are exchanged before they are repeated for their windows, so the exchange holds each about 1.2 times and what is
    worked out of a window needs no other. Frames with the same number of ``parts`` can be put together with no exchange."""
    spread = lambda a, b: F.explode(F.sequence(cell(lo(a, size, stride), GROUP), cell(hi(b, size, stride), GROUP)))
    return spread_out(df.withColumn(GROUPED[0], spread(x0, x1)).withColumn(GROUPED[1], spread(y0, y1)), *GROUPED, parts=parts)


def parts_of(*frames: DataFrame) -> int:
    """As many parts as shuffles have, or one for each ``PART`` bytes of the files that the frames read, if those are more.

    So a task's work and memory don't grow with the input. Frames that read no files count as nothing."""
    held = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        held += sum(n for n in sizes if n < 1 << 60)
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), min(held // PART, 10_000))


def spread_out(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Partitioned by the keys into ``parts``, or ``parts_of`` the frame: for rows whose work is greater than their bytes show,
    which Spark would put into few tasks."""
    return df.repartition(parts or parts_of(df), *keys)


def grouped(df: DataFrame) -> DataFrame:
    """With the groups of rows that have a window (col, row)."""
    return df if GROUPED[0] in df.columns else df.withColumns({g: cell(F.col(c), GROUP) for g, c in zip(GROUPED, ("col", "row"))})


def bounds(size: float = SIZE, stride: float = STRIDE) -> list[Column]:
    """xmin, ymin, xmax, ymax of the window (col, row)."""
    col, row, half = F.col("col") * stride, F.col("row") * stride, size / 2
    return [(c + d).cast("double").alias(n) for c, d, n in ((col, -half, "xmin"), (row, -half, "ymin"), (col, half, "xmax"), (row, half, "ymax"))]


def candidate_grid(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float, size: float = SIZE, stride: float = STRIDE) -> DataFrame:
    """All windows that lie within bounds: (col, row, xmin, ymin, xmax, ymax)."""
    import math

    c0, c1 = math.ceil((xmin + size / 2) / stride), math.floor((xmax - size / 2) / stride)
    r0, r1 = math.ceil((ymin + size / 2) / stride), math.floor((ymax - size / 2) / stride)
    if c1 < c0 or r1 < r0:
        return spark.createDataFrame([], "col long, row long").select("col", "row", *bounds(size, stride))
    rows = spark.range(r0, r1 + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1).cast("long"))).alias("col"))
    return rows.select("col", "row", *bounds(size, stride))


def cell(value: Column, side: float) -> Column:
    return F.floor(value / side).cast("long")


def block_of(x: Column, y: Column, side: float = BLOCK) -> list[Column]:
    """Processing-block indices of a point."""
    return [cell(x, side).alias("block_col"), cell(y, side).alias("block_row")]
