"""Profiles of columns, keys and hierarchies, each in one aggregate pass where that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

QUANTILES = {"q00": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def exact_quantiles(values: DataFrame, by: list[str], v: str, probabilities: dict[str, float], cells: int = 4096) -> DataFrame:
    """by and a column for each quantile, interpolated between neighbours; v must hold finite numbers.

    Values are counted in ``cells`` equal parts of each group's range; then only the parts in which a wanted rank lies are
    counted by value. So no task holds all values of a group, and no value is estimated. Ranges and wanted parts, a few rows
    a group, are broadcast: joined by exchange, all values of a group would go through one task. Groups should be fewer than a million.
    """
    span = values.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    placed = values.select(*by, v).join(F.broadcast(span.select(*by, "_lo", "_hi")), by).select(*by, v, part.alias("_cell"))
    up_to = lambda keys, order, count: F.sum(count).over(Window.partitionBy(*keys).orderBy(order)) - F.col(count)
    counts = placed.groupBy(*by, "_cell").agg(F.count("*").alias("_c")).withColumn("_before", up_to(by, "_cell", "_c"))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("at")) for n, p in probabilities.items())))
    ranks = span.select(*by, asked.alias("_q")).select(*by, F.col("_q.name").alias("_name"), F.col("_q.at").alias("_at"))
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    wanted = counts.join(F.broadcast(ranks), by).filter("_rank >= _before AND _rank < _before + _c").select(*by, "_name", "_at", "_rank", "_cell", "_before")
    inside = placed.join(F.broadcast(wanted.select(*by, "_cell").distinct()), [*by, "_cell"], "left_semi").groupBy(*by, "_cell", v).agg(F.count("*").alias("_m"))
    inside = inside.withColumn("_within", up_to([*by, "_cell"], v, "_m"))
    found = inside.join(F.broadcast(wanted), [*by, "_cell"]).filter("_rank >= _before + _within AND _rank < _before + _within + _m")
    low, high = F.min_by(v, "_rank"), F.max_by(v, "_rank")
    each = found.groupBy(*by, "_name").agg((low + (high - low) * (F.first("_at") - F.min("_rank"))).alias("_value"))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in probabilities))


def numeric_summary(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n, mean, std, quantiles) over finite values; the deviation is the population's."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").filter(finite(F.col("v")))
    out = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    out = out.join(exact_quantiles(long, ["column"], "v", QUANTILES), "column")
    return out.select("column", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", *QUANTILES)))


def column_profile(df: DataFrame, *columns: str) -> DataFrame:
    """(column, rows, nulls, distinct, duplicates, empty, whitespace_only, padded, missing_tokens, leading_zeros, negative, zero, non_finite, id_candidate) of columns as text.

    Columns become rows first and distinct values are counted by grouping, so that no state of a whole column sits in one
    task. A candidate for an identifier is named like one, has no null and is unique for 95 % of its rows.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    values = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    n, v, number = F.col("n"), F.col("v"), F.expr("try_cast(v AS DOUBLE)")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    out = values.groupBy("column").agg(
        F.sum("n").alias("rows"), total(v.isNull()).alias("nulls"), F.count("v").alias("distinct"), total(v == "").alias("empty"), total((v != "") & (F.trim(v) == "")).alias("whitespace_only"), total(v != F.trim(v)).alias("padded"),
        total(text.is_missing_token(v)).alias("missing_tokens"), total(text.has_leading_zero(v)).alias("leading_zeros"), total(finite(number) & (number < 0)).alias("negative"), total(number == 0).alias("zero"), total(number.isNotNull() & ~finite(number)).alias("non_finite"),
    )
    named = F.col("column").isin([c for c in columns if text.is_identifier_name(c)])
    candidate = named & (F.col("nulls") == 0) & (F.coalesce(text.safe_rate(F.col("distinct"), F.col("rows")), F.lit(0.0)) >= 0.95)
    return out.withColumn("duplicates", F.col("rows") - F.col("nulls") - F.col("distinct")).withColumn("id_candidate", candidate)


def key_summary(df: DataFrame, key: str) -> DataFrame:
    """(rows, unique_keys, duplicate_keys, null_keys)."""
    return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("k").alias("unique_keys"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys")
    )


def join_profile(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """One row: key counts on either side, in common and on one side only, cardinality and match rates."""
    counts = lambda df, key, n: df.filter(F.col(key).isNotNull()).groupBy(text.normalized_key(F.col(key)).alias("k")).agg(F.count("*").alias(n))
    both = counts(left, left_key, "l").join(counts(right, right_key, "r"), "k", "full_outer")
    one = both.agg(
        F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common_keys"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(F.col("l") > 1).alias("left_duplicates"), F.count_if(F.col("r") > 1).alias("right_duplicates"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("joined_rows"),
    )
    side = lambda c: F.when(F.col(c) > 0, "many").otherwise("one")
    return one.withColumn("cardinality", F.concat(side("left_duplicates"), F.lit(":"), side("right_duplicates"))).withColumn("left_match", F.round(text.safe_rate(F.col("common_keys"), F.col("left_keys")), 6)).withColumn(
        "verdict", F.when(F.col("common_keys") == 0, "disjoint").when((F.col("left_only") == 0) & (F.col("right_only") == 0), "equal").when(F.col("left_only") == 0, "left within right").when(F.col("right_only") == 0, "right within left").otherwise("overlapping")
    )


def hierarchy_ambiguity(df: DataFrame, *levels: str) -> DataFrame:
    """(parent, child, children, ambiguous, most_parents) for each pair of adjacent levels."""
    pairs = F.array(*(F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.col(p).cast("string").alias("pv"), F.col(c).cast("string").alias("cv")) for p, c in zip(levels, levels[1:])))
    parents = df.select(F.explode(pairs).alias("x")).select("x.*").filter("cv IS NOT NULL").distinct().groupBy("parent", "child", "cv").agg(F.count("pv").alias("n"))
    return parents.groupBy("parent", "child").agg(F.count("*").alias("children"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.max("n").alias("most_parents"))


def attribute_join(geometry: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """One-to-one join of two frames by key. A key that is missing on a side, null or repeated fails the job.

    Both sides are grouped by key with their rows counted, so the check costs no pass of its own.
    """
    pack = lambda df, n, s: df.groupBy(key).agg(F.count("*").alias(n), F.first(F.struct(*[c for c in df.columns if c != key])).alias(s))
    both = pack(geometry, "_g", "_gs").join(pack(attributes, "_a", "_as"), key, "full_outer")
    bad = F.col(key).isNull() | F.col("_g").isNull() | F.col("_a").isNull() | (F.col("_g") > 1) | (F.col("_a") > 1)
    checked = both.filter(F.when(bad, F.raise_error(F.concat(F.lit("not one to one at key "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True)))
    clash = set(geometry.columns) & set(attributes.columns) - {key}
    return checked.select(key, "_gs.*", *(F.col(f"_as.{c}").alias(f"{c}_attribute" if c in clash else c) for c in attributes.columns if c != key))


def unmatched_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(key, side) of the distinct keys on one side only."""
    l, r = left.select(F.col(left_key).alias("key")).distinct(), right.select(F.col(right_key).alias("key")).distinct()  # noqa: E741
    return l.join(r, "key", "left_anti").withColumn("side", F.lit("left")).union(r.join(l, "key", "left_anti").withColumn("side", F.lit("right")))


def endpoint_integrity(links: DataFrame, nodes: DataFrame, tolerances: tuple[float, ...] = (0.0, 0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(metric, value): missing nodes, self loops, isolated nodes, and endpoints within each tolerance of their node."""
    ends = links.select(F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("xa").alias("ex"), F.col("ya").alias("ey")), F.struct(F.col("to_node").alias("node"), F.col("xb").alias("ex"), F.col("yb").alias("ey")))).alias("e")).select("e.*")
    joined = ends.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node", "left")
    gap = F.hypot(F.col("ex") - F.col("x"), F.col("ey") - F.col("y"))
    one = joined.agg(F.count("*").alias("endpoints"), F.count_if(F.col("x").isNull()).alias("missing_nodes"), *(F.count_if(gap <= t).alias(f"within_{t:g}") for t in tolerances), F.count_distinct("node").alias("used_nodes"))
    loops = links.agg(F.count_if(F.col("from_node") == F.col("to_node")).alias("self_loops"))
    isolated = nodes.join(ends, nodes["id"] == ends["node"], "left_anti").agg(F.count("*").alias("isolated_nodes"))
    melt = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("long").alias("value")) for c in df.columns))).alias("m")).select("m.*")
    return melt(one).union(melt(loops)).union(melt(isolated))
