"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, and only the bag has labels (quality, toxic). Features of a word
are the word, its first bytes, what follows it up to the next word, and whether it repeats the word before it, all as
64-bit hashes. The vocabulary is the features of which the share of documents differs by at least ``LEAST_Z`` standard
errors between the classes of a label; without that choice the many rare words are learned by heart.
A passage is encoded as h = tanh(sum of its features' vectors / sqrt(words) + b). For each label a gated attention,
softmax over the bag of w . (tanh(V h) * sigmoid(U h)), weighs the passages, and the label's logit is read off the
weighted mean of their encodings. Every passage of every document is scored; nothing is cut off.

The fit takes at most ``sample`` labelled documents of each combination of labels, those of least hash, and runs in one
task; the weights (about 1 MB) are broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, only, share, type_of
from .textkit import U, Words, distinct, slices

PASSAGE = 64
LEAST_Z = 5.0
SLOT_BITS = 20
WIDTH = 16
GATE = 8
PREFIXES = (4, 5)
KINDS = 5
AGAIN = 0x5DEECE66D  # the feature of a repeated word


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(KINDS, words) feature hashes; first word of each passage; number of passages of each row."""
    words = Words(texts, prefixes=PREFIXES, gaps=8)
    again = np.zeros(len(words.hash), U)
    again[1:][words.hash[1:] == words.hash[:-1]] = AGAIN
    passages = -(-words.count // PASSAGE)
    inside = np.arange(passages.sum()) - np.repeat(np.cumsum(passages) - passages, passages)
    return np.stack([words.hash, *(words.prefix[p] for p in PREFIXES), words.gap, again]), np.repeat(words.first[:-1], passages) + inside * PASSAGE, passages


def _vocabulary(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Hashes of the features that tell the classes of a label apart."""
    each = [distinct(d.reshape(-1)) for d in docs]
    found, inverse = np.unique(np.concatenate(each), return_inverse=True)
    owner = np.repeat(np.arange(len(docs)), [len(e) for e in each])
    total = np.bincount(inverse, minlength=len(found))
    keep = np.zeros(len(found), bool)
    for t in range(labels.shape[1]):
        ones = labels[:, t] > 0
        n1, n0 = ones.sum(), (~ones).sum()
        if n1 and n0:
            in1 = np.bincount(inverse, weights=ones[owner], minlength=len(found))
            share = total / len(docs)
            error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
            keep |= np.abs(in1 / n1 - (total - in1) / n0) >= LEAST_Z * error
    return found[keep & (total > 1) & (found > 0)]


def encode_sums(table: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Sum of features' vectors / sqrt(words) of each passage. at: the word of each known feature, in order."""
    length = np.diff(np.append(starts, words))
    out = np.zeros((len(starts), table.shape[1]), np.float32)
    if len(at):
        passage = np.searchsorted(starts, at, "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        out[passage[edges]] = np.add.reduceat(table[ids], edges, axis=0)
    return out / np.sqrt(np.maximum(length, 1))[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.learn(np.zeros(0, U))
        normal = lambda *shape: (rng.normal(size=shape) * 0.5).astype(np.float32)
        self.b, self.v, self.u, self.w, self.c, self.d = normal(WIDTH) * 0.1, normal(WIDTH, GATE), normal(WIDTH, GATE), normal(GATE, 2), normal(2, WIDTH), np.zeros(2, np.float32)

    def learn(self, vocabulary: np.ndarray) -> None:
        self.keys = np.append(vocabulary, U(0))  # the last stands for any other
        self.table = np.zeros((len(vocabulary), WIDTH), np.float32)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) of the vocabulary's features among (KINDS, words) hashes, by word."""
        if len(self.keys) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[(self.keys[:-1] >> U(64 - SLOT_BITS)).astype(np.int64)] = True
        kind, word = np.nonzero(slots[(hashes >> U(64 - SLOT_BITS)).astype(np.int64)])
        found = hashes[kind, word]
        ids = np.searchsorted(self.keys[:-1], found)
        sure = self.keys[ids] == found
        word, ids = word[sure], ids[sure]
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def bags(self, sums: np.ndarray, passages: np.ndarray) -> dict:
        """Forward pass; bag i holds the next passages[i] rows of sums."""
        at = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        h = np.tanh(sums + self.b)
        a, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (a * g) @ self.w
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        alpha = e / np.add.reduceat(e, at)[bag]
        z = np.stack([np.add.reduceat(alpha[:, [t]] * h, at) for t in (0, 1)], axis=1)
        return dict(at=at, bag=bag, h=h, a=a, g=g, alpha=alpha, z=z, p=_sigmoid((z * self.c).sum(2) + self.d))

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of (b, v, u, w, c, d), and of the passages' sums."""
        at, bag, h, a, g, alpha = (f[k] for k in ("at", "bag", "h", "a", "g", "alpha"))
        dlogit = (f["p"] - y) * weight
        dz = dlogit[:, :, None] * self.c
        dalpha = np.einsum("pth,ph->pt", dz[bag], h)
        dh = np.einsum("pt,pth->ph", alpha, dz[bag])
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, at)[bag])
        dm = de @ self.w.T
        da, dg = dm * g * (1 - a * a), dm * a * g * (1 - g)
        dh += da @ self.v.T + dg @ self.u.T
        dsum = dh * (1 - h * h)
        return [dsum.sum(0), h.T @ da, h.T @ dg, (a * g).T @ de, np.einsum("dt,dth->th", dlogit, f["z"]), dlogit.sum(0)], dsum


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross-entropy of both labels, each class of a label weighing the same."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not len(texts):
        model.c[:] = 0
        return model
    raw, rows = [], []
    for at, part in slices(texts):
        hashes, starts, passages = features(part)
        first = np.cumsum(passages) - passages
        ends = np.append(starts, hashes.shape[1])
        for i in np.flatnonzero(passages):
            raw.append((hashes[:, starts[first[i]] : ends[first[i] + passages[i]]], starts[first[i] : first[i] + passages[i]] - starts[first[i]]))
            rows.append(at + i)
    labels = labels[rows]
    model.learn(_vocabulary([h for h, _ in raw], labels) if raw else np.zeros(0, U))
    docs = [(*model.known(h), s, h.shape[1]) for h, s in raw]
    del raw
    share = labels.mean(0)
    weight = np.where(labels > 0, 0.5 / np.maximum(share, 1e-3), 0.5 / np.maximum(1 - share, 1e-3)).astype(np.float32)
    params = [model.b, model.v, model.u, model.w, model.c, model.d, model.table]
    first_m, second_m, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            picked = [docs[i] for i in part]
            shift = np.cumsum([0] + [d[3] for d in picked])
            at, ids = np.concatenate([d[0] + x for d, x in zip(picked, shift)]), np.concatenate([d[1] for d in picked])
            starts = np.concatenate([d[2] + x for d, x in zip(picked, shift)])
            forward = model.bags(encode_sums(model.table, at, ids, starts, int(shift[-1])), np.array([len(d[2]) for d in picked]))
            grads, dsum = model.gradients(forward, labels[part], weight[part] / len(part))
            dsum = dsum / np.sqrt(np.diff(np.append(starts, shift[-1])))[:, None]
            each, table = dsum[np.searchsorted(starts, at, "right") - 1], np.zeros_like(model.table)
            by = np.argsort(ids, kind="stable")
            values = ids[by]
            edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(ids) else np.zeros(0, np.int64)
            if len(edges):
                table[values[edges]] = np.add.reduceat(each[by], edges, axis=0)
            step += 1
            for p, m, v, gr in zip(params, first_m, second_m, [*grads, table]):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def score(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2) probabilities of quality and toxic, and the number of passages."""
    hashes, starts, passages = features(texts)
    sums = encode_sums(model.table, *model.known(hashes), starts, hashes.shape[1])
    empty = passages == 0
    if empty.any():  # a bag needs a passage: one of no words
        bounds = np.cumsum(passages) - passages
        sums = np.insert(sums, bounds[empty], 0, axis=0)
    return model.bags(sums, np.maximum(passages, 1))["p"] if len(texts) else np.zeros((0, 2)), passages


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 1500, seed: int = 7) -> Model:
    """Fit on at most ``sample`` labelled documents of each (quality, toxic); rows with a null among these are not used."""
    marks = only(labels, doc="doc_id", quality="quality", toxic="toxic").filter("doc IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("doc").agg(F.min(F.struct("quality", "toxic")).alias("y")).select("doc", (F.col("y.quality") > 0).cast("int").alias("q"), (F.col("y.toxic") > 0).cast("int").alias("t"))
    chosen = marks.withColumn("k", F.row_number().over(Window.partitionBy("q", "t").orderBy(F.xxhash64("doc", F.lit(seed)), "doc"))).filter(F.col("k") <= sample)
    rows = only(docs, doc="doc_id", text="text").filter("text IS NOT NULL").join(F.broadcast(chosen.select("doc", "q", "t")), "doc")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [("place", "ascending"), ("more", "ascending")]))
        y = np.stack([table["q"].to_numpy(), table["t"].to_numpy()], axis=1).astype(np.float32)
        model = fit(table["text"].combine_chunks(), y, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample alone is brought together: the scan and the join stay spread out.
    # Its order is by hashes of id and text, so that no tie is left to the order of arrival (rows alike in both are alike).
    found = arrow(rows.select(F.xxhash64("doc", F.lit(seed)).alias("place"), F.xxhash64("text").alias("more"), "text", "q", "t").repartition(1), run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(pa.array([], pa.string()), np.zeros((0, 2), np.float32), seed=seed)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 1500, quality: float = 0.5, toxic: float = 0.5, seed: int = 7) -> DataFrame:
    """(doc_id, quality, toxic, passages, keep) for every row: probabilities and whether the document stays.

    It stays with quality >= ``quality`` and toxic <= ``toxic``. A null text has null scores and goes; a text without
    words is scored on the biases alone; with no labelled rows all scores are 0.5 and all texts stay. Null ids and
    repeated rows are scored like any other, equal texts alike. Other columns are ignored whatever their names.
    """
    shared = share(spark, train(spark, docs, labels, sample, seed))
    kind = type_of(docs, "doc_id")

    def run(batches):
        model = shared()
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 20):
                p, passages = score(model, texts)
                p = np.round(p.astype(np.float64), 6)
                null = pc.is_null(texts)
                q, t = (pc.if_else(null, pa.scalar(None, pa.float64()), pa.array(p[:, k])) for k in (0, 1))
                keep = pc.and_(pc.invert(null), pa.array((p[:, 0] >= quality) & (p[:, 1] <= toxic)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), q, t, pa.array(passages.astype(np.int32)), keep], ["doc_id", "quality", "toxic", "passages", "keep"])

    return arrow(only(docs, doc="doc_id", text="text"), run, f"doc_id {kind}, quality double, toxic double, passages int, keep boolean")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 1500, quality: float = 0.5, toxic: float = 0.5, seed: int = 7) -> DataFrame:
    """The rows of the input that ``classify`` keeps with the same parameters, with all their columns whatever their names.

    Decided row by row, with nothing shuffled: repeated rows and equal texts alike, null ids as any other. A null text
    goes; an empty one is judged on the biases alone; an empty table stays empty; without labelled rows all texts stay.
    """
    shared = share(spark, train(spark, docs, labels, sample, seed))

    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        kept = []
        for _, part in slices(texts, 1 << 20):
            p = np.round(score(shared(), part)[0].astype(np.float64), 6)
            kept.append((p[:, 0] >= quality) & (p[:, 1] <= toxic))
        return pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    return docs.filter(F.col("text").isNotNull() & stays(F.col("text")))
