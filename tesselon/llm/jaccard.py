"""N-gram Jaccard join with adaptive multi-match prefixes.

All links of documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``; exact, with no cap
on partners or candidates.

Any two sets with Jaccard >= t share at least ceil(t * larger size) n-grams. With every set in one global order (rarest
first), the first ``size - ceil(t * size) + m`` n-grams of both then share at least m, for m up to ceil(t * size): the m-match prefix.
Each document chooses its own m by estimated cost, and a pair is verified once it shares min(m, m') prefix n-grams.

1. Documents of the same words in the same order are copies: they are found by a 128-bit fingerprint with partial minima
   and stand behind their least one from here on, so that a text that fills a third of the corpus is one set.
2. One document of ``SAMPLE``, by hash, tells which n-grams are so frequent that no task should hold all their
   documents. These come last in the global order, by a table of bounded size that all tasks have; so they need no counting.
3. The other n-grams are packed into arrays by hash range and exchanged once; document frequencies are counted there. What
   occurs in one document only goes no further: it comes first in the order, matches nothing, and is known to each
   document as the difference between its size and what returns. Most documents end here, since such n-grams fill their prefix.
4. Per document: order, cost, m, prefix. The cost of m is the sum of the other entries in the prefix's lists plus, for
   each document expected among them m times or more (that sum / m at most), the n-grams that verification reads.
5. Lists of prefix n-grams are gathered by their least document, so that a group of near copies becomes one incidence
   matrix; its product with itself, in blocks, counts the shared prefix n-grams of all its pairs. A list of more than
   ``LIST`` documents is cut by their hashes into cells, and every two cells are a matrix, and so a unit of work, of their
   own; frequent n-grams are cut so before they are gathered at all.
6. Candidates are verified in clusters on whole sets: a document's set is sent once per pair of clusters, not per pair.
   A partition is sorted by cluster and read as a stream, one cluster at a time.

Partitions follow the bytes of the texts (``PART_BYTES`` each), not the session's setting alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import arrow, only, parts_for, release, row_keys, settle, share, type_of
from .textkit import U, Words, binary, by_part, mix, runs, slices, spread

MOST_MATCHES = 8
FLUSH = 1_000_000
BLOCK = 1024
CLUSTER = 512
LIST = 4096
PART_BYTES = 64 << 20
SAMPLE = 64  # one document of so many is looked at for frequent n-grams
FREQUENT = 1024  # so often in the sample is frequent; about 65,000 documents
MOST_FREQUENT = 1 << 20  # entries of the table (16 MB); any further n-gram is counted and listed like the rest
SENT = 4 << 20  # n-grams in a batch


def _whole(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return [b for b in batches if b.num_rows]


def _join(column: str, batches: list[pa.RecordBatch], kind: type) -> np.ndarray:
    parts = [b.column(column) for b in batches]
    data = b"".join(v for c in parts for v in c.to_pylist() if v)
    return np.frombuffer(data, kind)


def _entries(batches: list[pa.RecordBatch], owners: str = "docs", counts: str = "counts") -> np.ndarray:
    return np.repeat(_join(owners, batches, np.int64), _join(counts, batches, np.uint32))


def _squeeze(part: np.ndarray, parts: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order entries by part, then as they are; (order, bounds, owners and counts of the runs of one owner, their bounds)."""
    order, bounds = by_part(part, parts)
    sorted_owner, sorted_part = owner[order], part[order]
    change = np.ones(len(order), bool)
    change[1:] = (sorted_owner[1:] != sorted_owner[:-1]) | (sorted_part[1:] != sorted_part[:-1])
    at = np.flatnonzero(change)
    counts = np.diff(np.append(at, len(order))).astype(np.uint32)
    run_bounds = np.searchsorted(at, bounds)
    return order, bounds, sorted_owner[at], counts, run_bounds


def _rows(part_count: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    parts = pa.array(np.arange(part_count, dtype=np.int32))
    filled = np.zeros(part_count, bool)
    for c in columns.values():
        filled |= np.diff(np.frombuffer(c.buffers()[1], np.int32)) > 0
    keep = pa.array(np.flatnonzero(filled))
    if len(keep):
        yield pa.RecordBatch.from_arrays([parts.take(keep), *(c.take(keep) for c in columns.values())], ["part", *columns])


def _outline(n: int):
    """Step 1: fingerprint and number of words of each document; step 2: n-grams of the sampled documents."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in slices(batch.column(1)):
                words, key = Words(texts), ids[at : at + len(texts)]
                place = mix(np.arange(len(words.hash)).astype(U) - np.repeat(words.first[:-1], words.count).astype(U))
                prints = []
                for salt in (U(0), U(0x5851F42D4C957F2D)):
                    total = np.zeros(len(words.hash) + 1, U)
                    np.cumsum(mix(words.hash * (place | U(1)) + place + salt), out=total[1:])
                    prints.append((total[words.first[1:]] - total[words.first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(words.count), pa.array(prints[0]), pa.array(prints[1]), pa.array((mix(key.view(U)) >> U(32)).astype(np.int64)), pa.nulls(len(key), pa.int64())], OUTLINE)
                some = np.flatnonzero(mix(key.view(U)) % U(SAMPLE) == 0)
                if len(some):
                    gram, bounds = words.grams(n)
                    found = np.concatenate([np.unique(gram[bounds[i] : bounds[i + 1]]) for i in some]).view(np.int64)
                    no = pa.nulls(len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays([no, no, no, no, no, pa.array(found)], OUTLINE)

    return run


OUTLINE = ["key", "words", "fp1", "fp2", "home", "gram"]


class Frequent:
    """The frequent n-grams with their place in the global order (from 2**32 - 1 downwards) and their estimated documents."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.lexsort((grams, counts))
        rank = np.empty(len(grams), np.int64)
        rank[order] = (1 << 32) - len(grams) + np.arange(len(grams))
        by = np.argsort(grams)
        self.grams, self.rank, self.counts = grams[by], rank[by].astype(np.uint32), counts[by] * SAMPLE

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is frequent, where in the table)."""
        if not len(self.grams):
            return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return self.grams[at] == grams, at

    def estimate(self, dfs: np.ndarray) -> np.ndarray:
        """Documents of n-grams given by frequency or, for frequent ones, by their place in the order."""
        out = dfs.astype(np.float64)
        low = (1 << 32) - len(self.grams)
        often = dfs >= low
        by_rank = np.empty(len(self.grams), np.int64)
        by_rank[self.rank.astype(np.int64) - low] = self.counts
        out[often] = by_rank[dfs[often].astype(np.int64) - low]
        return out


def home(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(U)) >> U(32)).astype(np.int64) % parts


def _shingles(n: int, parts: int, frequent):
    """Step 3, map side: packed n-grams by hash range; and, on the way to a document's own part, its size and frequent n-grams."""

    def emit(grams, docs, sizes):
        gram = np.concatenate(grams)
        doc, size = np.concatenate(docs), np.concatenate(sizes)
        owner = np.repeat(doc, size)
        often, at = frequent().find(gram)
        place = (gram >> U(32)).astype(np.int64) % parts
        seldom = ~often
        order, bounds, owners, counts, run_bounds = _squeeze(place[seldom], parts, owner[seldom])
        own = home(doc, parts)
        meta, meta_bounds = by_part(own, parts)
        known = np.flatnonzero(often)
        k_order, k_bounds, k_owners, k_counts, k_runs = _squeeze(home(owner[known], parts), parts, owner[known])
        yield from _rows(
            parts, grams=binary(gram[seldom][order], bounds), docs=binary(owners, run_bounds), counts=binary(counts, run_bounds),
            mdocs=binary(doc[meta], meta_bounds), sizes=binary(size[meta].astype(np.uint32), meta_bounds),
            kgrams=binary(gram[known][k_order], k_bounds), kdfs=binary(frequent().rank[at[known]][k_order], k_bounds), kdocs=binary(k_owners, k_runs), kcounts=binary(k_counts, k_runs),
        )

    def run(batches):
        held = ([], [], [])
        waiting = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in slices(batch.column(1)):
                words = Words(texts)
                gram, bounds = words.grams(n)
                sets = [np.unique(gram[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
                size = np.array([len(s) for s in sets], np.int64)
                keep = size > 0
                if not keep.any():
                    continue
                for into, value in zip(held, (np.concatenate(sets), ids[at : at + len(texts)][keep], size[keep])):
                    into.append(value)
                waiting += int(size.sum())
                if waiting >= FLUSH:
                    yield from emit(*held)
                    held, waiting = ([], [], []), 0
        if held[1]:
            yield from emit(*held)

    return run


RELAYED = ["mdocs", "sizes", "kgrams", "kdfs", "kdocs", "kcounts"]
SHINGLES = "part int, grams binary, docs binary, counts binary, " + ", ".join(f"{c} binary" for c in RELAYED)


def _frequencies(parts: int):
    """Step 3, reduce side: document frequencies; what two documents or more have goes back to its documents."""

    def run(batches):
        batches = _whole(batches)
        if not batches:
            return
        for b in batches:  # what is on its way to its document's part goes on
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("part"), none, none, none, none, *(b.column(c) for c in RELAYED)], FREQUENCIES_NAMES)
        gram, doc = _join("grams", batches, U), _entries(batches)
        order = np.argsort(gram)
        gram, doc = gram[order], doc[order]
        bounds = runs(gram)
        df = np.diff(bounds)
        often = np.repeat(df > 1, df)
        gram, doc, df = gram[often], doc[often], np.repeat(df, df)[often].astype(np.uint32)
        order = np.argsort(doc, kind="stable")
        gram, doc, df = gram[order], doc[order], df[order]
        for k in range(0, len(gram), SENT):
            g, d, f = gram[k : k + SENT], doc[k : k + SENT], df[k : k + SENT]
            order, bounds, owners, counts, run_bounds = _squeeze(home(d, parts), parts, d)
            for b in _rows(parts, grams=binary(g[order], bounds), dfs=binary(f[order], bounds), docs=binary(owners, run_bounds), counts=binary(counts, run_bounds)):
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, pa.binary()) for _ in RELAYED)], FREQUENCIES_NAMES)

    return run


FREQUENCIES_NAMES = ["part", "grams", "dfs", "docs", "counts", *RELAYED]
FREQUENCIES = "part int, " + ", ".join(f"{c} binary" for c in FREQUENCIES_NAMES[1:])


def matches(df: np.ndarray, size: int, singles: int, threshold: float) -> tuple[int, int]:
    """(m, number of repeated n-grams in the prefix) of least estimated cost. df: of a set's repeated n-grams, in order."""
    need = math.ceil(threshold * size - 1e-9)
    m = np.arange(1, max(1, min(MOST_MATCHES, need)) + 1)  # more than ``need`` matches aren't owed by any pair
    length = np.clip(size - need + m - singles, 0, len(df))
    others = np.concatenate([[0], np.cumsum(df - 1.0)])[length]
    best = int(np.argmin(others + others / m * size))
    if others[0] == 0:
        best = 0
    return best + 1, int(length[best])


def _prefixes(threshold: float, parts: int, frequent):
    """Step 4. kind 0: packed prefix n-grams by hash range (a frequent one by cells); 1: a document's set."""

    def run(batches):
        batches = _whole(batches)
        if not batches:
            return
        copies = np.concatenate([b.column("copy").drop_null().to_numpy() for b in batches])
        mdoc, size = _join("mdocs", batches, np.int64), _join("sizes", batches, np.uint32)
        gram = np.concatenate([_join("grams", batches, U), _join("kgrams", batches, U)])
        df = np.concatenate([_join("dfs", batches, np.uint32), _join("kdfs", batches, np.uint32)])
        doc = np.concatenate([_entries(batches), _entries(batches, "kdocs", "kcounts")])
        order = np.lexsort((gram, df, doc))
        gram, df, doc = gram[order], df[order], doc[order]
        by = np.argsort(mdoc)
        mdoc, size = mdoc[by], size[by].astype(np.int64)
        start, end = np.searchsorted(doc, mdoc, "left"), np.searchsorted(doc, mdoc, "right")
        single = size - (end - start)
        free = size - np.ceil(threshold * size - 1e-9).astype(np.int64)
        documents = frequent().estimate(df)
        chosen, m_of, length = [], [], []
        for i in np.flatnonzero(~np.isin(mdoc, copies) & (single <= free) & (end > start)):
            m, n = matches(documents[start[i] : end[i]], int(size[i]), int(single[i]), threshold)
            if n:
                chosen.append(i), m_of.append(m), length.append(n)
        chosen, m_of, length = np.array(chosen, np.int64), np.array(m_of, np.uint32), np.array(length, np.int64)
        names = ["kind", "part", "doc", "size", "grams", "docs", "counts", "sizes", "ms", "cells"]

        def table(kind, rows, **columns):
            kinds = dict(part=pa.int32(), doc=pa.int64(), size=pa.int32(), grams=pa.binary(), docs=pa.binary(), counts=pa.binary(), sizes=pa.binary(), ms=pa.binary(), cells=pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *(columns.get(c, pa.nulls(rows, k)) for c, k in kinds.items())], names)

        low = (1 << 32) - len(frequent().grams)
        total = np.cumsum(end - start)[chosen] if len(chosen) else chosen
        at_chosen = 0
        while at_chosen < len(chosen):
            k = slice(at_chosen, max(at_chosen + 1, int(np.searchsorted(total, total[at_chosen] + SENT // 8))))
            at_chosen = k.stop
            c = chosen[k]
            at = spread(start[c], length[k])
            own = np.repeat(np.arange(len(c)), length[k])
            # Cells of a frequent n-gram: every two of them that hold the document, numbered in a square of 2**bits a side.
            cell, often = np.zeros(len(at), np.int64), df[at] >= low
            if often.any():
                bits = np.ceil(np.log2(np.maximum(documents[at[often]] / LIST, 1))).astype(np.int64)
                seat = seats(mdoc[c][own[often]], bits)
                times = 1 << bits
                other = spread(np.zeros(len(bits), np.int64), times)
                seat, bits = np.repeat(seat, times), np.repeat(bits, times)
                cells = _cell(bits, np.minimum(seat, other), np.maximum(seat, other))
                at = np.concatenate([at[~often], np.repeat(at[often], times)])
                own = np.concatenate([own[~often], np.repeat(own[often], times)])
                cell = np.concatenate([cell[~often], cells])
            place = ((gram[at] ^ mix(cell.view(U)) * (cell > 0).astype(U)) >> U(32)).astype(np.int64) % parts
            order, bounds = by_part(place, parts)
            at, own = at[order], own[order]
            for b in _rows(parts, grams=binary(gram[at], bounds), docs=binary(mdoc[c][own], bounds), sizes=binary(size[c][own].astype(np.uint32), bounds), ms=binary(m_of[k][own], bounds), cells=binary(cell[order], bounds)):
                yield table(0, b.num_rows, **{x: b.column(x) for x in b.schema.names})
            for x in range(0, len(c), 1000):
                i = c[x : x + 1000]
                n = end[i] - start[i]
                sets = gram[spread(start[i], n)]
                yield table(1, len(i), doc=pa.array(mdoc[i]), size=pa.array(size[i].astype(np.int32)), grams=binary(sets, np.concatenate([[0], np.cumsum(n)])))

    return run


def _cell(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the cell (i, j) of a square of 2**bits a side; 0 where the list isn't cut."""
    return np.where(bits > 0, bits << 56 | i << 28 | j, 0)


def seats(docs: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The row of such a square in which a document stands."""
    return (mix(docs.view(U)) & U((1 << 28) - 1)).astype(np.int64) & ((1 << bits) - 1)


PREFIXES = "kind int, part int, doc long, size int, grams binary, docs binary, counts binary, sizes binary, ms binary, cells binary"


def _lists(parts: int):
    """Step 5, first exchange: the documents of each prefix n-gram, sent to their least one; long lists by cells."""

    def run(batches):
        batches = _whole(batches)
        if not batches:
            return
        gram, cell = _join("grams", batches, U), _join("cells", batches, np.int64)
        doc, size, m = (_join(c, batches, k) for c, k in (("docs", np.int64), ("sizes", np.uint32), ("ms", np.uint32)))
        order = np.lexsort((doc, cell, gram))
        gram, cell, doc, size, m = gram[order], cell[order], doc[order], size[order], m[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(gram)))
        keep = n > 1
        start, n = start[keep], n[keep]
        # A long list that came uncut is cut here: its documents go to every cell that holds them.
        long = (n > LIST) & (cell[start] == 0)
        at = [spread(start[~long], n[~long])]
        of, code = [np.repeat(np.flatnonzero(~long), n[~long])], [cell[at[0]]]
        for k in np.flatnonzero(long).tolist():
            entries = np.arange(start[k], start[k] + n[k])
            bits = np.full(n[k], math.ceil(math.log2(n[k] / LIST)))
            own = seats(doc[entries], bits)
            for other in range(1 << int(bits[0])):
                at.append(entries), of.append(np.full(n[k], k)), code.append(_cell(bits, np.minimum(own, other), np.maximum(own, other)))
        at, of, code = np.concatenate(at), np.concatenate(of), np.concatenate(code)
        order = np.lexsort((at, code, of))
        at, of, code = at[order], of[order], code[order]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        keep = n > 1
        start, n = start[keep], n[keep]
        leader, code = doc[at[start]], code[start]
        done = 0
        total = np.cumsum(n)
        while done < len(start):
            k = slice(done, max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SENT))))
            done = k.stop
            order, part_bounds = by_part(home(leader[k] ^ mix(code[k].view(U)).view(np.int64), parts), parts)
            s, c, l, x = start[k][order], n[k][order], leader[k][order], code[k][order]
            entries = at[spread(s, c)]
            ends = np.concatenate([[0], np.cumsum(c)])[part_bounds]
            yield from _rows(parts, leaders=binary(l, part_bounds), cells=binary(x, part_bounds), counts=binary(c.astype(np.uint32), part_bounds), docs=binary(doc[entries], ends), sizes=binary(size[entries], ends), ms=binary(m[entries], ends))

    return run


LISTS = "part int, leaders binary, cells binary, counts binary, docs binary, sizes binary, ms binary"


def _products(rows: np.ndarray, columns: np.ndarray, k: int, m: int, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared) for i < j of the m columns of a k x m incidence matrix given by its entries, block by block; with i < split <= j, if given."""
    order = np.lexsort((rows, columns))
    rows, columns = rows[order], columns[order]
    for i0 in range(0, m if split is None else split, BLOCK):
        i1 = min(i0 + BLOCK, m if split is None else split)
        for j0 in range(i0 if split is None else split, m, BLOCK):
            j1 = min(j0 + BLOCK, m)
            ri, rj = (slice(*np.searchsorted(columns, [x, y])) for x, y in ((i0, i1), (j0, j1)))
            shared = np.zeros((i1 - i0, j1 - j0), np.float32)
            for k0 in range(0, k, 4096):
                a, b = (np.zeros((min(4096, k - k0), x), np.float32) for x in shared.shape)
                for into, at, x0 in ((a, ri, i0), (b, rj, j0)):
                    r, c = rows[at], columns[at]
                    here = (r >= k0) & (r < k0 + 4096)
                    into[r[here] - k0, c[here] - x0] = 1
                shared += a.T @ b
            i, j = np.nonzero(np.triu(shared, 1) if i0 == j0 else shared)
            yield i + i0, j + j0, shared[i, j].astype(np.int64)


def _pairs(threshold: float):
    """Step 5, second exchange: shared prefix n-grams of all pairs under one least document, or in one cell of it."""

    def out(a, b, shared, need):
        for k in range(0, len(a), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(shared[s].astype(np.int32)), pa.array(need[s].astype(np.int32))], ["a", "b", "shared", "need"])

    def run(batches):
        batches = _whole(batches)
        if not batches:
            return
        leader, cell, n = _join("leaders", batches, np.int64), _join("cells", batches, np.int64), _join("counts", batches, np.uint32).astype(np.int64)
        doc, size, m = (_join(c, batches, k) for c, k in (("docs", np.int64), ("sizes", np.uint32), ("ms", np.uint32)))
        start = np.cumsum(n) - n
        plain = cell == 0
        two = start[(n == 2) & plain]
        if len(two):
            fits = np.minimum(size[two], size[two + 1]) >= threshold * np.maximum(size[two], size[two + 1]) - 1e-9
            two = two[fits]
            order = two[np.lexsort((doc[two + 1], doc[two]))]
            a, b = doc[order], doc[order + 1]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            yield from out(a[new], b[new], np.diff(np.append(new, len(a))), np.minimum(m[order], m[order + 1])[new])
        more = np.flatnonzero((n > 2) | ~plain)
        more = more[np.lexsort((cell[more], leader[more]))]
        new = np.ones(len(more), bool)
        new[1:] = (leader[more][1:] != leader[more][:-1]) | (cell[more][1:] != cell[more][:-1])
        bounds = np.append(np.flatnonzero(new), len(more))
        for g in range(len(bounds) - 1):
            lists = more[bounds[g] : bounds[g + 1]]
            at = spread(start[lists], n[lists])
            docs, where, columns = np.unique(doc[at], return_index=True, return_inverse=True)
            sizes, ms = size[at][where].astype(np.float64), m[at][where]
            code, split = int(cell[lists[0]]), None
            if code:
                own = seats(docs, code >> 56)
                i, j = code >> 28 & (1 << 28) - 1, code & (1 << 28) - 1
                if i != j:  # pairs across the two rows alone; those within a row have a cell of their own
                    order = np.argsort(own != i, kind="stable")
                    split = int((own == i).sum())
                    docs, sizes, ms = docs[order], sizes[order], ms[order]
                    columns = np.argsort(order)[columns]
            for i, j, shared in _products(np.repeat(np.arange(len(lists)), n[lists]), columns, len(lists), len(docs), split):
                fits = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
                i, j = i[fits], j[fits]
                yield from out(np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j]), shared[fits], np.minimum(ms[i], ms[j]))

    return run


def _verify(threshold: float):
    """Step 6: exact similarity of the candidates of each key from the sets that came along. Rows come sorted by key."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column("key")[-1] != held[0].column("key")[0]:
                table = pa.Table.from_batches(held)
                cut = int(np.searchsorted(table.column("key").to_numpy(), batch.column("key")[-1].as_py()))
                yield from verified(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from verified(pa.Table.from_batches(held))

    def verified(table):
        key, a, b = (table.column(c).to_numpy() for c in ("key", "a", "b"))
        sets = table.column("grams")
        sets = sets.combine_chunks() if sets.num_chunks != 1 else sets.chunk(0)
        is_set = ~sets.is_null().to_numpy(zero_copy_only=False)
        size = table.column("size").fill_null(0).to_numpy()
        order = np.lexsort((b, a, ~is_set, key))
        bounds = runs(key[order])
        found: list[list] = [[], [], []]
        for g in range(len(bounds) - 1):
            rows = order[bounds[g] : bounds[g + 1]]
            held, pairs = rows[is_set[rows]], rows[~is_set[rows]]
            docs, sizes = a[held], size[held].astype(np.int64)
            values = [np.frombuffer(sets[int(r)].as_py(), U) for r in held]
            i, j = np.searchsorted(docs, a[pairs]), np.searchsorted(docs, b[pairs])
            if len(pairs) * 4 < len(held) ** 1.5 or len(held) < 5:
                shared = np.array([len(np.intersect1d(values[x], values[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
            else:
                length = [len(v) for v in values]
                _, column = np.unique(np.concatenate(values), return_inverse=True)
                row = np.repeat(np.arange(len(values)), length)
                total = np.zeros((len(values), len(values)), np.float32)
                by = np.argsort(column, kind="stable")
                row, column = row[by], column[by]
                for c0 in range(0, int(column[-1]) + 1, 8192):
                    s = slice(*np.searchsorted(column, [c0, c0 + 8192]))
                    part = np.zeros((len(values), min(8192, int(column[-1]) + 1 - c0)), np.float32)
                    part[row[s], column[s] - c0] = 1
                    total += part @ part.T
                shared = total[i, j].astype(np.int64)
            similar = shared / (sizes[i] + sizes[j] - shared)
            keep = similar >= threshold - 1e-12
            for into, value in zip(found, (a[pairs][keep], b[pairs][keep], similar[keep])):
                into.append(value)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in found], ["a", "b", "jaccard"])

    return run


def similar_sets(spark: SparkSession, rows: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (key, text): (pairs, copies, keys). pairs: (a, b, jaccard) of keys that stand for their copies; copies:
    (key, rep) of documents of the same words as one of a lesser key; keys: all of them."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = parts_for(spark, size, PART_BYTES)
    outline = settle(arrow(rows, _outline(n), ", ".join(f"{c} long" for c in OUTLINE)), "outline")
    often = outline.filter("gram IS NOT NULL").groupBy("gram").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).toPandas()
    frequent = share(spark, Frequent(often["gram"].to_numpy(np.int64).view(U), often["count"].to_numpy(np.int64)))
    prints = outline.filter("key IS NOT NULL")
    mark = ["fp1", "fp2", "words"]
    same = prints.filter(F.col("words") >= n).groupBy(*mark).agg(F.min("key").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = settle(prints.join(same, mark).filter("key <> rep").select("key", "rep", "home"), "copies")

    shingles = arrow(rows, _shingles(n, parts, frequent), SHINGLES).repartitionById(parts, F.col("part"))
    counted = arrow(shingles, _frequencies(parts), FREQUENCIES).withColumn("copy", F.lit(None).cast("long"))
    known = copies.select(F.pmod("home", F.lit(parts)).cast("int").alias("part"), *(F.lit(None).cast("binary").alias(c) for c in FREQUENCIES_NAMES[1:]), F.col("key").alias("copy"))
    prefixes = settle(arrow(counted.union(known).repartitionById(parts, F.col("part")), _prefixes(threshold, parts, frequent), PREFIXES), "prefixes")

    lists = arrow(prefixes.filter("kind = 0").select("part", "grams", "docs", "sizes", "ms", "cells").repartitionById(parts, F.col("part")), _lists(parts), LISTS)
    shared = arrow(lists.repartitionById(parts, F.col("part")), _pairs(threshold), "a long, b long, shared int, need int")
    candidates = settle(shared.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b"), "candidates")

    homes = candidates.select("a", "b").union(candidates.select(F.col("a"), F.col("a"))).groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("home"))
    sized = homes.groupBy("home").agg(F.ceil(F.count("*") / CLUSTER).alias("blocks"))
    placed = homes.join(sized, "home").select("doc", F.struct("home", F.pmod(F.xxhash64("doc"), "blocks").alias("block")).alias("place"))
    keyed = (
        candidates.join(placed.select(F.col("doc").alias("a"), F.col("place").alias("pa")), "a")
        .join(placed.select(F.col("doc").alias("b"), F.col("place").alias("pb")), "b")
        .select(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("key"), "a", "b")
    )
    keyed = settle(keyed, "keyed")
    sets = prefixes.filter("kind = 1").select(F.col("doc").alias("a"), "size", "grams")
    wanted = keyed.select("key", "a").union(keyed.select("key", F.col("b"))).distinct()
    sent = wanted.join(sets, "a").select("key", "a", F.lit(0).cast("long").alias("b"), "size", "grams")
    both = sent.union(keyed.select("key", "a", "b", F.lit(None).cast("int"), F.lit(None).cast("binary")))
    pairs = arrow(both.repartition(parts, "key").sortWithinPartitions("key"), _verify(threshold), "a long, b long, jaccard double")
    return settle(pairs, "pairs"), copies.select("key", "rep"), prints.select("key")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links, best) for every document.

    ``links`` is how many other documents have a Jaccard similarity of at least ``threshold`` with it, copies counted
    each; ``best`` the greatest such similarity, null without a link; ``class_id`` the least id of those that it is
    linked to, directly or through others, itself included. So rows grow as the documents do, however large a group is.

    Rows with a null id or text are left out. Texts of fewer than n words (the empty text too) have no set and no links,
    copies of each other or not. Rows that repeat an id and its text are one document; an id with several texts has a
    row for each. Ids may be of any type that has an order. Other columns are ignored whatever their names; an empty
    table gives an empty result.
    """
    rows = only(docs, doc=doc_id, text=text).filter("doc IS NOT NULL AND text IS NOT NULL")
    keyed, names = row_keys(rows, distinct=True)
    pairs, copies, keys = similar_sets(spark, keyed.select("key", "text"), n, threshold)
    sizes = copies.groupBy("rep").agg((F.count("*") + 1).alias("n"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "jaccard").union(pairs.select("b", "a", "jaccard"))
    linked = both.join(sizes.select(F.col("rep").alias("other"), "n"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("links"), F.max("jaccard").alias("best"))
    roots = groups(spark, pairs.select("a", "b")).select(F.col("doc").alias("rep"), "root")
    stats = linked.join(sizes, "rep", "full").join(roots, "rep", "left").select(
        "rep", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("links"), F.when(F.col("n").isNotNull(), F.lit(1.0)).otherwise(F.col("best")).alias("best")
    )
    stats = settle(stats, "linked")
    of = keys.join(copies, "key", "left").select("key", F.coalesce("rep", "key").alias("rep"))
    out = of.join(stats, "rep", "left").select("key", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.round("best", 9).alias("best"))
    if names is None:
        kind = type_of(rows, "doc")
        return out.select(F.col("key").cast(kind).alias("doc_id"), F.col("root").cast(kind).alias("class_id"), "links", "best")
    roots = names.select(F.col("key").alias("root"), F.col("doc").alias("class_id"))
    return out.join(names.select("key", F.col("doc").alias("doc_id")), "key").join(roots, "root").select("doc_id", "class_id", "links", "best")


def groups(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(doc, root) for each document of the pairs (a, b) but the roots: the least document of its connected component.

    Alternating large-star and small-star steps; each is written to the shared folder, what it replaces is deleted, and
    the count of changed edges alone comes to the driver.
    """
    edges = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = settle(small.filter("u <> v").distinct(), "small")
        done = small.exceptAll(edges).limit(1).count() == 0 and edges.exceptAll(small).limit(1).count() == 0
        release(large, small if done else edges)
        if done:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))
        edges = small


def one_of_each_group(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """The input without the rows that are joined, directly or through others, to one before them.

    Rows are in the order of their ids; rows that share an id are told apart by their other columns, so that of repeated
    rows one stays, and a different text under a clashing id is judged by itself. Rows with a null id or text, and texts
    of fewer than n words, stay. All columns are kept whatever their names; an empty table stays empty. Texts travel
    only where a filter of the rows to go lets them through.
    """
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed, names = row_keys(named, "doc_id", "text", into=ROW)
    pairs, copies, _ = similar_sets(spark, keyed.select(F.col(ROW).alias("key"), "text"), n, threshold)
    gone = settle(groups(spark, pairs.select("a", "b")).select(F.col("doc").alias(GONE)).union(copies.select("key")), "gone")
    tested = keyed.withColumn(MAYBE, bloom.may_hold(spark, bloom.build(gone, GONE), F.col(ROW)))
    stay = tested.filter(~F.col(MAYBE)).union(tested.filter(MAYBE).join(gone, F.col(ROW) == F.col(GONE), "left_anti"))
    return stay.select(*docs.columns).union(docs.filter("doc_id IS NULL OR text IS NULL"))


ROW, GONE, MAYBE = "__row__", "__gone__", "__maybe__"


def ngram_jaccard_sql(n: int = 5, threshold: float = 0.5) -> str:
    at = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"""
WITH RECURSIVE named AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS k FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
words AS (SELECT k, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM named),
grams AS (SELECT DISTINCT k, g FROM (SELECT k, unnest([{at} FOR i IN range(1, len(w) - {n - 2})]) AS g FROM words WHERE len(w) >= {n})),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
linked AS (SELECT a, b, shared.n / (x.n + y.n - shared.n)::DOUBLE AS j FROM shared JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE shared.n / (x.n + y.n - shared.n)::DOUBLE >= {threshold}),
reach(k, r) AS (SELECT k, k FROM named UNION SELECT reach.k, linked.b FROM reach JOIN linked ON linked.a = reach.r),
roots AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
links AS (SELECT a AS k, count(*) AS links, round(max(j), 9) AS best FROM linked GROUP BY 1)
SELECT n.doc_id, m.doc_id AS class_id, coalesce(links, 0) AS links, best FROM named n JOIN roots USING (k) JOIN named m ON m.k = root LEFT JOIN links ON links.k = n.k"""
