"""Bit-exact identities, all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LINES = 25_000


def canonical_bytes(*fields: Column) -> Column:
    """Each field as N where null, else S, its UTF-8 length in 8 big-endian bytes, and its UTF-8."""
    parts = []
    for f in fields:
        text = f.cast("string")
        length = F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0"))
        parts.append(F.coalesce(F.concat(F.lit("S").cast("binary"), length, text.cast("binary")), F.lit("N").cast("binary")))
    return F.concat(*parts)


def canonical_hash(*fields: Column) -> Column:
    """Lower-case SHA-256 of the canonical bytes; it tells ("ab", "c") from ("a", "bc") and "" from null."""
    return F.sha2(canonical_bytes(*fields), 256)


def observation_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by '|'. A null or empty field is an error, since a join can't tell where it was."""
    text = [f.cast("string") for f in fields]
    bad = text[0].isNull() | (text[0] == "")
    for t in text[1:]:
        bad = bad | t.isNull() | (t == "")
    return F.when(bad, F.raise_error(F.lit("observation hash of a null or empty field"))).otherwise(F.sha2(F.concat_ws("|", *text), 256))


def source_object_id(object_type: Column, entity_type: Column, native: Column) -> Column:
    return canonical_hash(F.lit("source_object_id"), object_type, entity_type, native)


def decimal_text(value: int | float | str) -> str:
    """Shortest plain decimal text of a number, without exponent, trailing zeros or minus zero."""
    from decimal import Decimal

    number = Decimal(str(value)).normalize()
    return "0" if number == 0 else format(number, "f")


def window_id(domain: str, version: str, crs: str, origin: tuple, size: tuple, stride: tuple, col: Column, row: Column) -> Column:
    """Identity of a window's footprint: domain, version, CRS, origin x and y, width and height, stride x and y, column, row.

    ``domain`` is the name that the identities of a footprint are hashed under; whoever must match identities made
    elsewhere gives the name used there.
    """
    constants = [domain, version, crs, *(decimal_text(v) for v in (*origin, *size, *stride))]
    return canonical_hash(*(F.lit(c) for c in constants), col, row)


def block_id(domain: str, crs: str, size: float, col: Column, row: Column) -> Column:
    """Identity of a processing block: domain, CRS, size, column and row joined by '|'."""
    return observation_hash(F.lit(domain), F.lit(crs), F.lit(decimal_text(size)), col, row)


def observation_id(window: Column, object_type: Column, object_id: Column, part_id: Column | None = None) -> Column:
    """Identity of an object in a window; roads have one for each part, whose identity is then the last field."""
    own = observation_hash(window, object_type, object_id)
    return own if part_id is None else F.when(object_type == "road", observation_hash(window, object_type, object_id, part_id)).otherwise(own)


def clip_part_id(geometry_type: Column, wkb_sha256: Column, occurrence: Column) -> Column:
    return canonical_hash(F.lit("clip_part_id"), geometry_type, wkb_sha256, occurrence)


def source_geometry_id(object_id: Column, file_sha256: Column, wkb_sha256: Column) -> Column:
    return canonical_hash(F.lit("source_geometry_id"), object_id, file_sha256, wkb_sha256)


def district_id(source: Column, level: Column, code: Column) -> Column:
    return canonical_hash(F.lit("district_id"), source, level, code)


def node_id(domain: str, window: Column, kind: Column, primary: Column, secondary: Column) -> Column:
    """Identity of a road node of a window; ``secondary`` is null for nodes of the source."""
    return canonical_hash(F.lit(domain), window, kind, primary, secondary)


def edge_id(domain: str, window: Column, observation: Column, start_node: Column, end_node: Column) -> Column:
    return canonical_hash(F.lit(domain), window, observation, start_node, end_node)


def relation_context_id(window: Column, geometry_version: str, view: int | None = None) -> Column:
    """Identity of what relations are worked out on: a window's own geometry, or an augmented view of it (1 or 2)."""
    return canonical_hash(F.lit("relation_context_id"), window, F.lit("original" if view is None else "augmented"), F.lit(None if view is None else str(view)).cast("string"), F.lit(geometry_version))


def relation_id(context: Column, source: Column, target: Column, kind: Column) -> Column:
    return canonical_hash(F.lit("relation_id"), context, source, target, kind)


def is_identity(column: Column) -> Column:
    return column.rlike("^[0-9a-f]{64}$")


def row_digest(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``digest``, the canonical hash of the named columns (all, in order, if none are named)."""
    return df.withColumn("digest", canonical_hash(*(F.col(c) for c in columns or df.columns)))


def content_hash(df: DataFrame, header: list[str], columns: list[str], most_lines: int = MOST_LINES) -> DataFrame:
    """(rows, chunks, content_hash): a two-level hash of a table that doesn't depend on its row order.

    Digests are sorted; each run of ``most_lines`` of them is hashed, and the hashes of the runs, in order, under the
    header give the table's. The global number of a digest comes from the counts of 65,536 ranges, not from a
    window over the whole table; what reaches the last task is one digest a chunk.
    """
    digests = row_digest(df, *columns).select("digest")
    bucket = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")
    placed = digests.withColumn("b", bucket)
    sizes = placed.groupBy("b").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    ranked = placed.join(F.broadcast(before), "b").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("digest")) - 1)
    chunks = ranked.groupBy(F.floor(F.col("n") / most_lines).alias("chunk")).agg(F.count("*").alias("lines"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("digest"))), 256).alias("h"))
    head = F.sha2(F.lit("\n".join(header)), 256)
    return chunks.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"), F.count("*").alias("chunks"),
        F.sha2(F.concat_ws("\n", head, F.transform(F.sort_array(F.collect_list(F.struct("chunk", "h"))), lambda c: c["h"])), 256).alias("content_hash"),
    )
