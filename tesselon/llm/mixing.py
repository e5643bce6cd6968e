"""Mixing sources to target weights in blocks of fixed length.

1. Documents of a source are spread over buckets of about ``BUCKET_BYTES`` by a hash of their id and text (so that rows
   without an id are spread too). A source's tokens run from bucket to bucket, and within one by id, and are cut into
   blocks of ``block`` tokens; only the last block of a source may be shorter. Token counts alone number the blocks.
2. Each output shard draws how many blocks of each source it takes, a multinomial with the target weights.
3. The q-th block drawn from a source of n blocks is block p(q mod n), where p is a pseudorandom permutation of the
   source's block numbers (a Feistel network, walked until it falls below n), another one for each epoch q div n.
4. Slots are joined to blocks by source and block number, and travel to the buckets that hold the block's text (two or
   more, where it runs across their borders). A bucket of a source that is drawn for many epochs is read by several
   tasks, each for its share of the epochs. What comes out are the pieces of documents that make up the blocks.

A token is a run of non-space characters with the white space after it, so that pieces joined in order give back texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow, only, settle, type_of
from .textkit import U, binary, mix, raw, slices, spread

BUCKET_BYTES = 8 << 20
EPOCHS = 4  # that one task writes of a bucket, about
MOST_SOURCES = 100_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each token begins (a text's first token with the text itself), and for each row the tokens before it."""
    solid = ~SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] |= solid[edge]
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, offsets)
    has = np.flatnonzero(np.diff(first))
    starts[first[has]] = offsets[has]
    return starts, first


def permute(q: np.ndarray, n: int, key: int) -> np.ndarray:
    """The key's pseudorandom permutation of 0..n-1, at q."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    out, todo = q.astype(U), np.arange(len(q))
    while len(todo):
        x = out[todo]
        left, right = x >> U(half), x & low
        for r in range(4):
            left, right = right, left ^ (mix(right + U((key * 31 + r * 0x9E3779B97F4A7C15) % (1 << 64))) & low)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def source_key(seed: int, source: str, epoch: int) -> int:
    value = seed * 1_000_003 + epoch
    for b in source.encode():
        value = (value * 1_099_511_628_211 ^ b) % (1 << 64)
    return value


def _draw(seed: int, weights: np.ndarray, slots: int, shards: int):
    """(shard, slot, source number, j): slot holds the j-th block that the shard takes of the source."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = slots // shards + (shard < slots % shards)
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                counts = rng.multinomial(n, weights)
                source = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(rng.permutation(n)), pa.array(source), pa.array(spread(np.zeros(len(counts), np.int64), counts))], ["shard", "slot", "s", "j"])

    return run


def _choose(seed: int, names: list[str], blocks: list[int]):
    """Adds epoch and block number to slots that know q."""

    def run(batches):
        for batch in batches:
            s, q = batch.column("s").to_numpy(), batch.column("q").to_numpy()
            n = np.array(blocks, np.int64)[s]
            epoch, chosen = q // n, np.zeros(len(q), np.int64)
            order = np.lexsort((epoch, s))
            key = s[order] * (int(epoch.max(initial=0)) + 1) + epoch[order]
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
            for a, b in zip(bounds[:-1], bounds[1:]):
                at = order[a:b]
                chosen[at] = permute(q[at] % n[at], int(n[at[0]]), source_key(seed, names[int(s[at[0]])], int(epoch[at[0]])))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), pa.array([names[k] for k in s.tolist()], pa.string()), pa.array(epoch), pa.array(chosen)], ["shard", "slot", "source", "epoch", "number"])

    return run


def pieces(texts: pa.Array, block: int, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, block, first token within the block, tokens, text) of the pieces of texts that are run together, after ``before`` tokens, and cut into blocks."""
    data, offsets = raw(texts)
    starts, first = token_starts(data, offsets)
    total = len(starts)
    cuts = np.unique(np.concatenate([first[:-1][np.diff(first) > 0], np.arange(-before % block, total, block)]))
    ends = np.append(cuts[1:], total)[: len(cuts)]
    row = np.searchsorted(first, cuts, "right") - 1
    to = np.append(starts, len(data))[ends]
    to = np.minimum(to, offsets[row + 1])
    size = to - starts[cuts] if total else np.zeros(0, np.int64)
    whole = data[spread(starts[cuts], size)] if total else data[:0]
    return row, (before + cuts) // block, (before + cuts) % block, ends - cuts, binary(whole, np.concatenate([[0], np.cumsum(size)])).cast(pa.string())


def _assemble(block: int, schema: pa.Schema):
    """Of one bucket: the pieces of its documents, for each slot that asks for their block."""

    def run(docs: pa.Table, slots: pa.Table) -> pa.Table:
        if not docs.num_rows or not slots.num_rows:
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs, [("doc", "ascending"), ("tie", "ascending"), ("size", "ascending")], null_placement="at_start"))
        row, number, within, tokens, text = pieces(docs["text"].combine_chunks(), block, slots["before"][0].as_py())
        local = slots["number"].to_numpy()
        start, end = np.searchsorted(number, local, "left"), np.searchsorted(number, local, "right")
        at = spread(start, end - start)
        slot = np.repeat(np.arange(len(local)), end - start)
        text = text.take(pa.array(at))
        from_doc, from_slot = pa.array(row[at]), pa.array(slot)
        return pa.Table.from_arrays(
            [slots["shard"].take(from_slot), slots["slot"].take(from_slot), pa.array(within[at].astype(np.int32)), docs["doc"].take(from_doc), docs["lang"].take(from_doc), docs["source"].take(from_doc), slots["epoch"].take(from_slot), pa.array(tokens[at].astype(np.int32)), text],
            schema=schema,
        )

    return run


def _pieces_schema(kind: str) -> str:
    return f"shard long, slot long, first int, doc_id {kind}, lang string, source string, epoch long, tokens int, text string"


def mix_sources(
    spark: SparkSession, docs: DataFrame, block: int = 512, slots_a_shard: int = 4096, weights: dict[str, float] | None = None, power: float = 0.7, slots: int | None = None, seed: int = 11,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str | None = "lang",
) -> DataFrame:
    """(shard, slot, first, doc_id, lang, source, epoch, tokens, text): the pieces of the block in each slot; ``first`` is a piece's first token within it.

    ``weights`` gives sources their shares of blocks (sources it doesn't name get none); without it a share is
    proportional to the source's blocks to the ``power``. ``slots`` is how many blocks are drawn, by default as many as
    there are. A source drawn beyond its blocks starts another epoch, so its blocks repeat.

    Null, empty and blank texts have no tokens and are left out; a null source is the source ''; null ids are ordinary
    (first in order), repeated rows are packed each; ids may be of any type. Other columns are ignored whatever their
    names; an empty table gives an empty result. One row a source (at most ``MOST_SOURCES``) comes to the driver.
    """
    columns = dict(doc=doc_id, text=text, source=source) | ({"lang": lang} if lang else {})
    rows = only(docs, **columns).filter("text IS NOT NULL").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    kind = type_of(rows, "doc")
    empty = lambda: spark.createDataFrame([], _pieces_schema(kind))
    rows = rows.withColumn("lang", F.col("lang").cast("string") if lang else F.lit(None).cast("string"))
    counted = rows.groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not counted:
        return empty()
    buckets = spark.createDataFrame([(r["source"], max(1, -(-r["bytes"] // BUCKET_BYTES))) for r in counted], "source string, buckets long")
    placed = rows.join(F.broadcast(buckets), "source").withColumn("bucket", F.pmod(F.xxhash64("doc", "text"), "buckets")).drop("buckets")

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        found = [np.diff(token_starts(*raw(part))[1]) for _, part in slices(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    # One row a bucket; the running sums over a source's buckets are over one row for every BUCKET_BYTES of it.
    sizes = placed.groupBy("source", "bucket").agg(F.sum(count(F.col("text"))).alias("tokens")).filter("tokens > 0")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = settle(sizes.withColumn("before", before), "sizes")
    totals = {r["source"]: -(-r["tokens"] // block) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals)
    share = np.array([float(weights.get(n, 0.0)) if weights is not None else totals[n] ** power for n in names])
    slots = sum(totals.values()) if slots is None else slots
    if not names or share.sum() <= 0 or slots <= 0:
        return empty()
    share = share / share.sum()
    shards = -(-slots // slots_a_shard)
    drawn = arrow(spark.range(shards), _draw(seed, share, slots, shards), "shard long, slot long, s long, j long")
    taken = drawn.groupBy("shard", "s").agg(F.count("*").alias("n"))
    earlier = taken.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "s", F.coalesce("before", F.lit(0)).alias("before"))
    # Sizes of generated rows are guessed too low, so the joins are told not to broadcast them.
    numbered = drawn.join(earlier.hint("merge"), ["shard", "s"]).select("shard", "slot", "s", (F.col("before") + F.col("j")).alias("q"))
    chosen = arrow(numbered, _choose(seed, names, [totals[n] for n in names]), "shard long, slot long, source string, epoch long, number long")
    # The blocks of a bucket, those that it shares with its neighbours included.
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("tokens") - 1) / block)
    blocks = sizes.select("source", "bucket", "before", F.explode(F.sequence(first, last)).alias("number"))
    readers = spark.createDataFrame([(n, max(1, int(-(-share[k] * slots // (totals[n] * EPOCHS))))) for k, n in enumerate(names)], "source string, readers long")
    wanted = chosen.join(blocks.hint("merge"), ["source", "number"]).join(F.broadcast(readers), "source").withColumn("reader", F.pmod("epoch", "readers"))
    wanted = wanted.select("source", "bucket", "reader", "before", "number", "shard", "slot", "epoch")
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("first", pa.int32()), ("doc_id", to_arrow_type(rows.schema["doc"].dataType)), ("lang", pa.string()), ("source", pa.string()), ("epoch", pa.int64()), ("tokens", pa.int32()), ("text", pa.string())])
    texts = placed.join(F.broadcast(readers), "source").select("source", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("readers") - 1)).alias("reader"), "doc", F.xxhash64("text").alias("tie"), F.octet_length("text").alias("size"), "lang", "text")
    keys = ["source", "bucket", "reader"]
    return texts.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_assemble(block, schema), _pieces_schema(kind))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """As ``mix_sources``, in the columns of documents: a row for each piece, with its document's id, in whatever order.

    Nulls, empty texts, ties, repeated rows, empty tables and other columns are treated as there; columns beyond those
    of documents are not passed on, since a piece is no longer the document that they describe.
    """
    return mix_sources(spark, docs, **options).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
