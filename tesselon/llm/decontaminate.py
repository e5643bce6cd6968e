"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words over ``TERMS`` hashed terms give, in one pass, the document frequencies and the product
   of the term-passage matrix with a sparse sign matrix (two signs a passage, from its own position and document).
2. With inverse document frequencies applied, an orthonormal basis of that product spans the leading right singular
   space (randomised SVD). A second pass gathers the Gram matrix of all passages in it, whose eigenvectors and values
   complete the decomposition; terms map to singular directions scaled to unit variance.
3. A third pass compares windows of 16, 32 and 64 words, every 8 words of every text (16 for the longest), with each benchmark passage of
   about that length by cosine. Where it reaches ``cosine``, the words around are checked: their longest common
   subsequence with the item, and how much of the item's answer is there in order. Without an ``answer`` column the
   closing fifth of an item counts as its answer. Items of ``SHORT`` words or fewer are too small a part of a window for
   a cosine to tell; their words are looked up one by one, and checked wherever enough of them are close together.

No text is shuffled. Broadcast are the term table (16 MB) and the benchmark, ``MOST_BYTES`` of its text at a time: a longer
benchmark is cut by hash into parts, each with a pass of its own, and no item is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow, blobs, only, share, summed, type_of
from .textkit import U, Words, distinct, mix, runs, slices, spread

TERMS = 1 << 15
SKETCH = 128
PASSAGE = 32
STRIDE = 8
SCALES = (2, 4, 8)
SHORT = 12
MOST_BYTES = 8 << 20  # of benchmark text in one pass over the documents


def terms(words: Words) -> np.ndarray:
    return (words.hash >> U(49)).astype(np.int64)


def block_sums(table: np.ndarray, words: Words, starts: np.ndarray, width: int) -> np.ndarray:
    """Sums of the table's rows over ``width`` words from each start, or to the next start. The table's last row is zero."""
    ids = np.append(terms(words), len(table) - 1)
    ends = np.append(starts[1:], len(ids) - 1)
    total = table[ids[starts]]
    for k in range(1, width):
        at = starts + k
        total += table[ids[np.where(at < ends, at, len(ids) - 1)]]
    return total


def _passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and the row of each."""
    n = -(-words.count // PASSAGE)
    row = np.repeat(np.arange(words.rows), n)
    return words.first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * PASSAGE, row


def _sketch(batches):
    """Document frequencies, number of passages and terms x SKETCH sums of signs of this partition's passages."""
    df, passages = np.zeros(TERMS, np.int64), 0
    signed = np.zeros(TERMS * SKETCH, np.int64)
    held: tuple[list, list] = ([], [])

    def add(least: int) -> None:
        for keys, sign in zip(held, (1, -1)):
            if sum(map(len, keys)) > least:
                np.add(signed, sign * np.bincount(np.concatenate(keys), minlength=len(signed)), out=signed, casting="unsafe")
                keys.clear()

    for batch in batches:
        for _, texts in slices(batch.column(0)):
            words = Words(texts)
            starts, row = _passages(words)
            if not len(starts):
                continue
            ids = terms(words)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            df += np.bincount(distinct(passage * TERMS + ids) % TERMS, minlength=TERMS)
            passages += len(starts)
            seed = mix(words.hash[starts] ^ mix(words.hash[words.first[1:][row] - 1] + (starts - words.first[:-1][row]).astype(U)))
            for k in (0, 16):
                column, sign = ((seed >> U(k)) & U(SKETCH - 1)).astype(np.int64), 1 - 2 * ((seed >> U(k + 12)) & U(1)).astype(np.int64)
                key = ids * SKETCH + column[passage]
                positive = sign[passage] > 0
                held[0].append(key[positive].astype(np.int32))
                held[1].append(key[~positive].astype(np.int32))
            add(4_000_000)
    add(0)
    if passages:
        yield blobs(np.concatenate([signed, df, [passages]]).astype(np.int64))


def _gram(table):
    def run(batches):
        basis = table()
        total = np.zeros((SKETCH, SKETCH))
        for batch in batches:
            for _, texts in slices(batch.column(0), 2 << 20):
                words = Words(texts)
                starts, _ = _passages(words)
                if len(starts):
                    y = block_sums(basis, words, starts, PASSAGE)
                    total += (y.T @ y).astype(np.float64)
        yield blobs(total.reshape(-1))

    return run


def latent_space(spark: SparkSession, texts: DataFrame) -> np.ndarray:
    """(TERMS + 1, dimensions) float32: each term's inverse document frequency times its whitened singular directions, and zeros."""
    sums = summed(arrow(texts, _sketch, "part int, blob binary"), TERMS * SKETCH + TERMS + 1, np.int64)
    df, passages = sums[TERMS * SKETCH : -1].astype(np.float64), int(sums[-1])
    if passages == 0:
        return np.zeros((TERMS + 1, 1), np.float32)
    idf = np.log((passages + 1) / (df + 1)) * (df > 0)
    basis = np.linalg.qr(sums[: TERMS * SKETCH].reshape(TERMS, SKETCH) * idf[:, None])[0]
    weighted = np.vstack([basis * idf[:, None], np.zeros((1, SKETCH))]).astype(np.float32)
    gram = summed(arrow(texts, _gram(share(spark, weighted)), "part int, blob binary"), SKETCH * SKETCH, np.float64).reshape(SKETCH, SKETCH) / passages
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * max(values[-1], 1e-12)
    return (weighted @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)


class Benchmark:
    """The items as word hashes, and as unit vectors by scale."""

    def __init__(self, ids: list[int], texts: list[str], answers: list[str | None], space: np.ndarray):
        self.space = space
        words = Words(pa.array(texts, pa.string()))
        replies = Words(pa.array([a or "" for a in answers], pa.string()))
        self.items, self.queries = [], {m: ([], []) for m in SCALES}
        looked_up: list[tuple[int, int]] = []
        self.short_vectors = {}
        ids_of_terms = terms(words)
        for i, item in enumerate(ids):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if not len(own):
                continue
            reply = replies.hash[replies.first[i] : replies.first[i + 1]]
            reply = reply if len(reply) else own[-max(3, len(own) // 5) :]
            masks = _masks(own)
            self.items.append((item, len(own), masks, len(reply), _masks(reply), set(masks)))
            if len(own) <= SHORT:
                looked_up += [(w, len(self.items) - 1) for w in masks]
                self.short_vectors[len(self.items) - 1] = space[ids_of_terms[words.first[i] : words.first[i + 1]]].sum(0)
                continue
            for at in range(0, len(own), 48) if len(own) > 64 else (0,):
                n = len(own) - at if len(own) <= 64 else min(48, len(own) - at)
                m = next((m for m in SCALES if n <= m * STRIDE * 5 // 4), SCALES[-1])
                vector = space[ids_of_terms[words.first[i] + at : words.first[i] + at + n]].sum(0)
                length = np.linalg.norm(vector)
                if length > 0:
                    self.queries[m][0].append(len(self.items) - 1)
                    self.queries[m][1].append(vector / length)
        looked_up.sort()
        self.short_words, self.short_items = np.array([w for w, _ in looked_up], U), np.array([k for _, k in looked_up], np.int64)
        self.sizes = np.array([n for _, n, *_ in self.items], np.int64)
        self.vocabulary = distinct(words.hash)
        self.queries = {m: (np.array(items, np.int64), np.array(vectors, np.float32).reshape(len(items), space.shape[1])) for m, (items, vectors) in self.queries.items()}
        self.bits = [self._bits(masks, n) if n > SHORT else None for _, n, masks, *_ in self.items]

    def _bits(self, masks: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary of an item's words, and their masks in 64-bit parts, a row each."""
        at = np.searchsorted(self.vocabulary, np.array(list(masks), U))
        return at, np.array([[v >> k & 0xFFFFFFFFFFFFFFFF for v in masks.values()] for k in range(0, n, 64)], U)

    def places(self, words: Words) -> np.ndarray:
        """Each word's place in the vocabulary, or its length where it isn't there."""
        at = np.searchsorted(self.vocabulary, words.hash)
        return np.where(self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words.hash, at, len(self.vocabulary)) if len(self.vocabulary) else at


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the n words that the masks stand for."""
    rows = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = rows & m
            rows = ((rows + u) | (rows - u)) & full
    return n - rows.bit_count()


def _near_words(bench: Benchmark, words: Words, lcs: float) -> tuple[np.ndarray, np.ndarray]:
    """(item, first word) of places where, within twice a short item's length, as many of its words stand as ``lcs`` asks."""
    low, high = (np.searchsorted(bench.short_words, words.hash, side) for side in ("left", "right"))
    place = np.repeat(np.arange(len(words.hash)), high - low)
    item = bench.short_items[spread(low, high - low)]
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    size = bench.sizes[item]
    last = np.arange(len(item)) + np.maximum(np.ceil(lcs * size - 1e-9).astype(np.int64), 1) - 1
    held = np.minimum(last, len(item) - 1)
    row = words.row()[place]
    found = (last < len(item)) & (item[held] == item) & (row[held] == row) & (place[held] - place < 2 * size)
    return item[found], place[found]


def _enough(bits: tuple[np.ndarray, np.ndarray], table: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Where between lo and hi words stand for ``least`` or more of an item's positions; no common subsequence is longer. table: zeros."""
    out = np.zeros(len(lo), np.int64)
    for part in bits[1]:
        table[bits[0]] = part
        for k in range(0, len(lo), 2048):
            a, b = lo[k : k + 2048, None], hi[k : k + 2048, None]
            at = np.minimum(a + np.arange(int((b - a).max())), b - 1)
            out[k : k + 2048] += np.bitwise_count(np.bitwise_or.reduce(table[places[at]], axis=1))
    table[bits[0]] = 0
    return out >= least


def leaks(bench: Benchmark, texts: pa.Array, cosine: float, lcs: float, verbatim: float, answer: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, cosine, share of the item in the longest common subsequence, share of its answer) of each leak."""
    words = Words(texts)
    blocks = -(-words.count // STRIDE)
    if not blocks.sum():
        return []
    row = np.repeat(np.arange(words.rows), blocks)
    at = np.cumsum(blocks) - blocks
    index = np.arange(len(row)) - np.repeat(at, blocks)
    starts = words.first[:-1][row] + index * STRIDE
    pad = SCALES[-1]  # as many empty blocks after each text: a window past its end is a shorter window
    sums = np.zeros((len(row) + pad * words.rows, bench.space.shape[1]), np.float32)
    sums[np.arange(len(row)) + pad * row] = block_sums(bench.space, words, starts, STRIDE)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if len(bench.short_words):
        ids, of_word = terms(words), words.row()
        for k, at_word in zip(*(x.tolist() for x in _near_words(bench, words, lcs))):
            item, n, masks, reply_n, reply, _ = bench.items[k]
            i = int(of_word[at_word])
            hi = min(int(words.first[i + 1]), at_word + 2 * n)
            around = words.hash[at_word:hi].tolist()
            share = common_subsequence(masks, n, around) / n
            if share >= lcs:
                replied = common_subsequence(reply, reply_n, around) / reply_n
                if share >= verbatim or replied >= answer:
                    vector, own = bench.space[ids[at_word:hi]].sum(0), bench.short_vectors[k]
                    length = float(np.linalg.norm(vector) * np.linalg.norm(own))
                    found = (share, replied, float(vector @ own) / length if length else 0.0)
                    best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), found)
    here = np.arange(len(row)) + pad * row
    places, table = bench.places(words), np.zeros(len(bench.vocabulary) + 1, U)
    reach = 1
    for m in SCALES:
        while reach < m:
            sums[:-reach] += sums[reach:]
            reach *= 2
        items, vectors = bench.queries[m]
        if not len(items):
            continue
        step = max(1, m // 4)  # a window starts at every quarter of its length, or every STRIDE words
        tried = np.flatnonzero(index % step == 0)
        window = sums[here[tried]]
        length = np.sqrt(np.einsum("ij,ij->i", window, window))
        for k in range(0, len(items), 256):
            close = window @ vectors[k : k + 256].T
            q, w = np.nonzero(close.T >= cosine * np.maximum(length, 1e-9))
            bounds = runs(q)
            passed = [np.zeros(0, np.int64)]
            for f, g in zip(bounds[:-1], bounds[1:]):
                x, n = tried[w[f:g]], bench.items[items[k + q[f]]][1]
                lo, hi = np.maximum(words.first[row[x]], starts[x] - n), np.minimum(words.first[row[x] + 1], starts[x] + m * STRIDE + n)
                passed.append(f + np.flatnonzero(_enough(bench.bits[items[k + q[f]]], table, places, lo, hi, lcs * n - 1e-9)))
            passed = np.concatenate(passed)
            for t, x, y in zip(w[passed].tolist(), tried[w[passed]].tolist(), q[passed].tolist()):
                item, n, masks, reply_n, reply, _ = bench.items[items[k + y]]
                i = int(row[x])
                lo, hi = max(int(words.first[i]), int(starts[x]) - n), min(int(words.first[i + 1]), int(starts[x]) + m * STRIDE + n)
                around = words.hash[lo:hi].tolist()
                share = common_subsequence(masks, n, around) / n
                if share >= lcs:
                    replied = common_subsequence(reply, reply_n, around) / reply_n
                    if share >= verbatim or replied >= answer:
                        found = (share, replied, float(close[t, y] / length[t]))
                        best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), found)
    return [(i, item, c, s, r) for (i, item), (s, r, c) in sorted(best.items())]


def prepare(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer") -> list:
    """The benchmark in the corpus's latent space, broadcast in parts. Items without an id or text are left out."""
    columns = dict(item=item_id, text=item_text) | ({"answer": answer} if answer in benchmark.columns else {})
    items = only(benchmark, **columns).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // MOST_BYTES))
    space = latent_space(spark, only(docs, text=text).filter("text IS NOT NULL"))
    out = []
    for k in range(parts):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect(), key=lambda r: (r["item"], r["text"]))
        out.append(share(spark, Benchmark([r["item"] for r in rows], [r["text"] for r in rows], [r["answer"] if "answer" in r else None for r in rows], space)))
    return out


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, lcs: float = 0.55, verbatim: float = 0.75, answer: float = 0.6,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): each item that a document holds, word for word or paraphrased.

    An item leaks where a window's cosine with it reaches ``cosine`` and either ``verbatim`` of its words stand around
    it in order, or ``lcs`` of them with ``answer`` of its answer; a short item, where they do within twice its length,
    whatever the cosine. Null and wordless texts and items match nothing; a null id is reported as null; repeated rows
    are reported each; of repeated items every id is. Ids of documents and items may be of any type. Other columns are
    ignored whatever their names; empty tables give an empty result.
    """
    rows = only(docs, doc=doc_id, text=text).filter("text IS NOT NULL")
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def search(shared):
        def run(batches):
            for batch in batches:
                for at, part in slices(batch.column(1), 1 << 20):
                    found = leaks(shared(), part, cosine, lcs, verbatim, answer)
                    if found:
                        rows, items, *scores = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows) + at)), pa.array(items, item_type), *(pa.array(np.round(s, 4)) for s in scores)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        return arrow(rows, run, f"doc_id {type_of(rows, 'doc')}, item_id {type_of(benchmark, 'item_id')}, cosine double, lcs double, answer double")

    return reduce(DataFrame.union, map(search, prepare(spark, docs, benchmark, text)))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, lcs: float = 0.55, verbatim: float = 0.75, answer: float = 0.6) -> DataFrame:
    """The rows of the input in which ``find_leaks`` finds no benchmark item, with all their columns whatever their names.

    A null, empty or wordless text holds no item and stays; repeated rows stay or go together; ids are not looked at;
    an empty table stays empty, and with an empty benchmark every row stays. Nothing is shuffled.
    """

    def cleaner(shared):
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            for at, part in slices(texts, 1 << 20):
                out[[at + x[0] for x in leaks(shared(), part, cosine, lcs, verbatim, answer)]] = False
            return pa.array(out)

        return clean

    for shared in prepare(spark, docs, benchmark):
        docs = docs.filter(cleaner(shared)(F.col("text")))
    return docs
