"""Exact dedup by composable polynomial fingerprints.

The fingerprint of bytes b0 b1 ... is the pair of sums (b_i + 1) * B**i modulo two primes below 2**31, with the length.
H(A + B) = H(A) + B**len(A) * H(B): a document of more than ``PIECE`` bytes is cut into rows, which are spread over the
cluster, hashed side by side and combined by their shifts. Within a row, chunks form one matrix, whose product with the
powers is exact in doubles (below 2**53).

Documents of equal fingerprint are compared with the least of them, chunk by chunk, on their bytes; each document's
chunks pass by, and only whether all were equal is kept. What differs from the least one (equal fingerprints of unequal
bytes) is compared among itself in another round. No fingerprint decides alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import arrow, only, settle, type_of
from .textkit import raw, slices, spread

PRIMES = (2147483647, 2147483629)
BASES = (1_103_515_245, 1_664_525_013)
CHUNK = 1024
PIECE = 1 << 18
TOGETHER = 256  # documents of a group compared with one copy of its least document


def _table(base: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out, np.float64)


POWERS = np.stack([_table(b, p, CHUNK) for b, p in zip(BASES, PRIMES)], axis=1)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint (h1, h2, length) of the bytes of a followed by those of b."""
    return *((x + pow(base, a[2], p) * y) % p for x, y, base, p in zip(a, b, BASES, PRIMES)), a[2] + b[2]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(rows, 2) fingerprints of a string array."""
    data, offsets = raw(texts)
    length = np.diff(offsets)
    chunks = -(-length // CHUNK)
    first = np.cumsum(chunks) - chunks
    out = np.zeros((len(length), 2), np.int64)
    if not len(data):
        return out
    index = np.arange(chunks.sum()) - np.repeat(first, chunks)
    start = np.repeat(offsets[:-1], chunks) + index * CHUNK
    size = np.minimum(CHUNK, np.repeat(offsets[1:], chunks) - start)
    matrix = np.zeros((len(start), CHUNK), np.float64)
    flat = matrix.reshape(-1)
    flat[spread(np.arange(len(start)) * CHUNK, size)] = data[spread(start, size)]
    flat[spread(np.arange(len(start)) * CHUNK, size)] += 1
    parts = (matrix @ POWERS).astype(np.int64)
    for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
        step = pow(base, CHUNK, prime)
        shift = np.ones(int(chunks.max()), np.int64)
        for i in range(1, len(shift)):
            shift[i] = shift[i - 1] * step % prime
        shifted = parts[:, k] % prime * shift[index] % prime
        out[chunks > 0, k] = np.add.reduceat(shifted, first[chunks > 0]) % prime
    return out


def _piece_prints(batches):
    """(doc, row, i, f1, f2, w1, w2, bytes) of pieces; w is the power by which what follows is shifted."""
    for batch in batches:
        for at, data in slices(batch.column(3), 1 << 20):
            found = fingerprints(data)
            size = np.diff(raw(data)[1])
            lengths, inverse = np.unique(size, return_inverse=True)
            w = [np.array([pow(b, int(n), p) for n in lengths], np.int64)[inverse] for b, p in zip(BASES, PRIMES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(data)) for c in range(3)), *(pa.array(x) for x in (found[:, 0], found[:, 1], *w, size))], ["doc", "row", "i", "f1", "f2", "w1", "w2", "bytes"])


def combined(pieces: Column) -> Column:
    """The fingerprint (f1, f2, bytes) of an array of pieces in order, by the rule of ``combine``, as a native expression."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(zero.alias("f1"), zero.alias("f2"), one.alias("w1"), one.alias("w2"), zero.alias("bytes"))
    step = lambda a, p: F.struct(
        *(((a[f"f{k}"] + a[f"w{k}"] * p[f"f{k}"]) % F.lit(m)).alias(f"f{k}") for k, m in zip((1, 2), PRIMES)),
        *((a[f"w{k}"] * p[f"w{k}"] % F.lit(m)).alias(f"w{k}") for k, m in zip((1, 2), PRIMES)), (a["bytes"] + p["bytes"]).alias("bytes"),
    )
    return F.aggregate(pieces, start, step, lambda a: F.struct(a["f1"].alias("f1"), a["f2"].alias("f2"), a["bytes"].alias("bytes")))


def _pieces(data: Column, size: int) -> Column:
    """An array (i, bytes) of a binary column's pieces. Cut by bytes, so each is copied once and none is searched for."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(data, i * size + 1, F.lit(size)).alias("bytes")))


def _with_data(prints):
    """Rows (doc, row, i, data) with their fingerprint beside them."""

    def run(batches):
        for batch in batches:
            found = list(prints([batch]))
            if found:
                table = pa.Table.from_batches(found)
                yield from pa.table([batch.column(0), batch.column(3), *(table.column(c) for c in ("f1", "f2", "bytes"))], ["doc", "data", "f1", "f2", "bytes"]).combine_chunks().to_batches()

    return run


def exact_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_id, copies) for every document: the least id with the same bytes, and how many ids have them.

    Rows with a null id or text are left out (they can't be named, or have no bytes); empty texts equal each other.
    Repeated rows give one row; an id with several texts gives a row for each. Ids may be of any type that has an order.
    Other columns are ignored whatever their names; an empty table gives an empty result.

    A group of copies is never gathered: its least id and its size are partial aggregates, and the documents' pieces
    meet those of the least one under a salt, of which a group has one for every ``TOGETHER`` documents.
    """
    rows = only(docs, doc=doc_id, text=text).filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", F.col("text").cast("binary").alias("data"))
    kind = type_of(rows, "doc")
    schema = f"doc {kind}, row long, i int, f1 long, f2 long, w1 long, w2 long, bytes long"
    mark = F.struct("f1", "f2", "bytes").alias("mark")
    few = rows.filter(F.octet_length("data") <= PIECE).select("doc", F.lit(0).cast("long").alias("row"), F.lit(0).alias("i"), "data")
    # Written, so that the row numbers that tie pieces together are the same wherever they are read.
    huge = rows.filter(F.octet_length("data") > PIECE).withColumn("row", F.monotonically_increasing_id())
    huge = huge.select("doc", "row", F.explode(_pieces(F.col("data"), PIECE)).alias("p"))
    huge = settle(huge.select("doc", "row", F.col("p.i").alias("i"), F.col("p.bytes").alias("data")), "pieces")
    folded = arrow(huge.repartition("row", "i"), _piece_prints, schema).groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("i", "f1", "f2", "w1", "w2", "bytes"))).alias("p"))
    folded = folded.select("doc", "row", combined(F.col("p")).alias("mark"))
    ids = settle(arrow(few, _piece_prints, schema).select("doc", mark).union(folded.select("doc", "mark")).distinct(), "fingerprints")

    leads = lambda suspects: suspects.groupBy("mark").agg(F.min("doc").alias("kept"), F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"), F.count("*").alias("n"))
    suspects = settle(ids.join(leads(ids).filter("n > 1").drop("n"), "mark"), "suspects")
    some = bloom.may_hold(spark, bloom.build(suspects.select("doc").distinct(), "doc"), F.col("doc"))
    small = arrow(few.filter(some), _with_data(_piece_prints), f"doc {kind}, data binary, f1 long, f2 long, bytes long").select("doc", F.lit(0).alias("i"), "data", mark)
    large = huge.join(folded, ["doc", "row"]).select("doc", "i", "data", "mark")
    texts = settle(small.union(large).join(suspects, ["doc", "mark"]), "suspected")
    asked, found = texts, None
    while True:
        lead = asked.filter("doc = kept").dropDuplicates(["mark", "i"]).select("mark", "i", F.col("data").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
        verdict = salted.join(lead, ["mark", "i", "salt"]).groupBy("doc", "mark", "kept").agg(F.min(((F.col("data") == F.col("lead")) | (F.col("doc") == F.col("kept"))).cast("int")).alias("same"))
        verdict = settle(verdict, "compared")
        same = verdict.filter("same = 1").select("doc", "mark", "kept")
        found = same if found is None else found.union(same)
        left = verdict.filter("same = 0").select("doc", "mark")
        if left.limit(1).count() == 0:
            break
        asked = settle(texts.drop("kept", "salts").join(left.join(leads(left).drop("n"), "mark"), ["doc", "mark"]), "suspected")
    sizes = found.groupBy("mark", "kept").agg(F.count("*").alias("copies"))
    found = found.join(sizes, ["mark", "kept"]).select("doc", "mark", "kept", "copies")
    return ids.join(found, ["doc", "mark"], "left").select(
        F.col("doc").alias("doc_id"), F.coalesce("kept", "doc").alias("kept_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies")
    )


EXACT_SQL = """
WITH rows AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
classes AS (SELECT text, min(doc_id) AS kept_id, count(*) AS copies FROM rows GROUP BY text)
SELECT doc_id, kept_id, copies FROM rows JOIN classes USING (text)"""
