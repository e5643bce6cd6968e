"""Line dedup by content-defined chunks.

Lines are hashed, and a hash over two neighbouring lines (blank ones are passed over) is rolled along a document. A chunk
boundary falls between two lines whose rolled hash occurs nowhere else, so that a boundary depends on its own two lines
alone and the same passage is cut alike wherever it stands. Chunks are thus the longest runs of lines of which each pair
of neighbours recurs, whatever their length; cutting where the rolled hash is 0 modulo a divisor leaves a third of the
repeated lines beside or between the cuts. A line of ``long_words`` words or more recurs by itself.

Of every recurring pair (or long line) whose bytes are found equal the first place stays and the lines of all others go;
blank lines within a removed chunk go with it. The first place of a line in the whole corpus always stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import arrow, only, settle, share, type_of
from .textkit import BLOCK, INV, POW, U, mix, polynomial, raw, slices, spread

LONG = U(0x6C62272E07BB0142)  # told apart from pairs by this
FIRST = U(0x9E3779B97F4A7C15)


class Lines:
    """Lines of a string array: start and end bytes, first line of each row, hash, blank or long."""

    def __init__(self, texts: pa.Array, long_words: int):
        self.data, offsets = raw(texts)
        data = self.data
        cut = np.flatnonzero(data == 10)
        self.start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")  # a row's first line, then one after each break
        self.first = np.searchsorted(cut, offsets) + np.arange(len(offsets))
        self.end = np.append(self.start[1:], 0)
        inner = np.ones(len(self.start), bool)
        inner[self.first[1:] - 1] = False
        self.end[inner] -= 1
        self.end[~inner] = offsets[1:]
        spaces = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(data == 32, out=spaces[1:])
        spaces = spaces[self.end] - spaces[self.start]
        self.blank = spaces == self.end - self.start
        self.long = spaces + 1 >= long_words
        self.hash = np.empty(len(self.start), U)
        size = self.end - self.start
        at = 0
        while at < len(self.start):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + BLOCK, "right")))
            if size[at] > BLOCK:
                self.hash[at] = mix(polynomial(data[base : self.end[at]]) + U(size[at]))[0]
                to = at + 1
            else:
                part = data[base : self.end[to - 1]].astype(U) + U(1)
                sums = np.zeros(len(part) + 1, U)
                np.cumsum(part * POW[: len(part)], out=sums[1:])
                s, e = self.start[at:to] - base, self.end[at:to] - base
                self.hash[at:to] = mix((sums[e] - sums[s]) * INV[s] + size[at:to].astype(U))
            at = to

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first line, last line) of all pairs of neighbouring lines and all long lines."""
        solid = np.flatnonzero(~self.blank)
        row = np.searchsorted(self.first, solid, "right") - 1
        a, b = solid[:-1], solid[1:]
        own = row[:-1] == row[1:]
        a, b = a[own], b[own]
        long = np.flatnonzero(self.long & ~self.blank)
        return np.concatenate([mix(mix(self.hash[a] + FIRST) + self.hash[b]), mix(self.hash[long] ^ LONG)]), np.concatenate([a, long]), np.concatenate([b, long])


def _keys(long_words: int):
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(Lines(texts, long_words).chunks()[0].view(np.int64))], ["key"])

    return run


def _bodies(long_words: int, repeated):
    """Chunks whose key may recur: key, doc, line within the text, and the bytes of the one or two lines."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                lines = Lines(texts, long_words)
                key, a, b = lines.chunks()
                hit = np.flatnonzero(repeated().test(key))
                if not len(hit):
                    continue
                key, a, b = key[hit], a[hit], b[hit]
                row = np.searchsorted(lines.first, a, "right") - 1
                one, two = lines.end[a] - lines.start[a], np.where(a == b, 0, lines.end[b] - lines.start[b] + 1)
                start = np.stack([lines.start[a], lines.start[b] - 1], axis=1).reshape(-1)  # the second with a line break before it
                size = np.stack([one, two], axis=1).reshape(-1)
                ends = np.cumsum(one + two)
                k = 0
                while k < len(hit):  # bodies are twice their lines at most; cut them into batches all the same
                    to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (64 << 20), "right")))
                    body = lines.data[spread(start[2 * k : 2 * to], size[2 * k : 2 * to])]
                    bounds = np.concatenate([[0], ends[k:to] - (ends[k - 1] if k else 0)])
                    bodies = pa.Array.from_buffers(pa.binary(), to - k, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(body))])
                    yield pa.RecordBatch.from_arrays([pa.array(key[k:to].view(np.int64)), batch.column(0).take(pa.array(row[k:to] + at)), pa.array((a[k:to] - lines.first[row[k:to]]).astype(np.int32)), bodies], ["key", "doc", "i", "body"])
                    k = to

    return run


def cleaned(texts: pa.Array, drops: pa.Array, long_words: int) -> tuple[pa.Array, np.ndarray]:
    """Texts without the chunks that ``drops`` names by line and key (null for none), and how many lines each has lost."""
    lines = Lines(texts, long_words)
    key, a, b = lines.chunks()
    marks = drops.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(drops), 0).to_numpy())
    pair = lambda line, k: np.rec.fromarrays([line, k], names="a,b")
    # A line that isn't there (of another text under the same id) matches nothing, since line and key are both compared.
    asked = np.sort(pair(lines.first[owner] + marks.field("i").to_numpy(), marks.field("key").to_numpy()))
    have = pair(a.astype(np.int64), key.view(np.int64))
    at = np.searchsorted(asked, have)
    gone = (at < len(asked)) & (asked[np.minimum(at, len(asked) - 1)] == have) if len(asked) else np.zeros(len(have), bool)
    depth = np.zeros(len(lines.start) + 1, np.int64)
    np.add.at(depth, a[gone], 1)
    np.add.at(depth, b[gone] + 1, -1)
    keep = np.cumsum(depth)[:-1] == 0
    removed = np.add.reduceat(~keep, lines.first[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    kept = np.flatnonzero(keep)
    of = np.searchsorted(lines.first, kept, "right") - 1
    last = np.append(of[1:] != of[:-1], True) if len(kept) else np.zeros(0, bool)
    length = lines.end[kept] - lines.start[kept]
    size = length + ~last  # with a line break, but for a text's last line
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.add.at(bounds, of + 1, size)
    out = np.full(int(size.sum()), 10, np.uint8)
    out[spread(np.cumsum(size) - size, length)] = lines.data[spread(lines.start[kept], length)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.cumsum(bounds).tobytes()), pa.py_buffer(out)]).cast(pa.string()), removed


def _clean(long_words: int):
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                text, removed = cleaned(texts, batch.column(2).slice(at, len(texts)), long_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), text, pa.array(removed.astype(np.int32))], ["doc_id", "text", "removed_lines"])

    return run


def later_places(bodies: DataFrame) -> DataFrame:
    """(doc, drops): line and key of each chunk (key, doc, i, body) whose bytes have an earlier place."""
    place = F.min(F.struct("doc", "i")).alias("at")
    found = bodies.groupBy("key").agg(F.min("body").alias("lo"), F.max("body").alias("hi"), place, F.count("*").alias("n")).filter("n > 1")
    found = settle(found.select("key", "at", (F.col("lo") == F.col("hi")).alias("sure")), "found")
    later = (F.col("doc") != F.col("at.doc")) | (F.col("i") != F.col("at.i"))
    again = bodies.select("key", "doc", "i").join(found.filter("sure").select("key", "at"), "key").filter(later).select("doc", "i", "key")
    if found.filter("NOT sure").limit(1).count():  # keys under which bytes differ: there each body is a chunk of its own
        mixed = bodies.join(found.filter("NOT sure").select("key"), "key", "left_semi")
        apart = mixed.join(mixed.groupBy("key", "body").agg(place, F.count("*").alias("n")).filter("n > 1"), ["key", "body"])
        again = again.union(apart.filter(later).select("doc", "i", "key"))
    return again.groupBy("doc").agg(F.collect_list(F.struct("i", "key")).alias("drops"))


def dedup_lines(spark: SparkSession, docs: DataFrame, long_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, removed_lines) for every row: its text without repeated chunks.

    The first place is that of the least id, then of the least line. Rows with a null id are passed on as they are and
    remove nothing elsewhere; a null text stays null; the empty text is one blank line. Rows that share an id count as
    one place, so repeated rows are cut alike; ids may be of any type that has an order. Other columns are ignored
    whatever their names; an empty table stays empty.

    A 64-bit key a line is counted with partial sums; the bytes of recurring chunks alone are exchanged, once, and
    compared by the least and the greatest of each key, again with partial results, so that no task holds all places of
    a chunk that stands in a third of the documents. Texts travel only where they lose lines.
    """
    rows = only(docs, doc=doc_id, text=text)
    named = rows.filter("doc IS NOT NULL AND text IS NOT NULL")
    kind = type_of(rows, "doc")
    keys = arrow(named.select("text"), _keys(long_words), "key long")
    repeated = settle(keys.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    hit = share(spark, bloom.build(repeated, "key", hashed=True))
    bodies = settle(arrow(named, _bodies(long_words, hit), f"key long, doc {kind}, i int, body binary"), "bodies")
    drops = settle(later_places(bodies), "drops")

    tested = rows.withColumn("touched", bloom.may_hold(spark, bloom.build(drops, "doc"), F.col("doc")))
    plain = tested.filter(~F.col("touched")).select(F.col("doc").alias("doc_id"), "text", F.lit(0).alias("removed_lines"))
    joined = tested.filter("touched").join(drops, "doc", "left").select("doc", "text", "drops")
    changed = arrow(joined.filter("text IS NOT NULL"), _clean(long_words), f"doc_id {kind}, text string, removed_lines int")
    return plain.union(changed).union(joined.filter("text IS NULL").select("doc", "text", F.lit(0)))


def lines_sql(long_words: int = 50) -> str:
    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
solid AS (SELECT *, len(string_split(line, ' ')) >= {long_words} AS is_long FROM lines WHERE replace(line, ' ', '') <> ''),
pairs AS (SELECT doc_id, i, lead(i) OVER w AS j, line || chr(10) || lead(line) OVER w AS body FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
chunks AS (SELECT * FROM pairs WHERE j IS NOT NULL UNION ALL SELECT doc_id, i, i, line FROM solid WHERE is_long),
gone AS (SELECT doc_id, i, j FROM chunks QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM gone),
left_over AS (SELECT doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) - coalesce(l.kept, 0) AS INTEGER) END AS removed_lines
FROM documents d LEFT JOIN left_over l USING (doc_id)"""
