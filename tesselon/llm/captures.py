"""Capture index of a web archive, merged from sorted runs.

Every input partition sorts its captures into runs of bounded length, which are written. Borders between ranges are drawn
from a sample of the runs, by (URL key, time, id, digest), so that a range holds about ``RANGE`` captures and those of one
URL may fill many ranges. Each range merges its segments of the k runs with a loser tree, one record at a time, reading
every segment in its own order in small slices. Captures are numbered within a URL: the few URLs that lie on a border are
counted by range beforehand, and each range begins with its number. Ranges follow each other, so the output as written
is in global order. Only index records travel, never payloads.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, only, parts_for, settle, share, type_of
from .urls import canonical, canonical_sql

RUN = 50_000
RANGE = 1_000_000
SLICE = 1024
END = (1,)


def url_key(url: Column) -> Column:
    """Sort-friendly form of a canonical URL: host labels reversed, then the path, as in ``org,example)/a``."""
    c = canonical(url)
    host = F.regexp_extract(c, "^[^/?]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.substring(c, F.length(host) + 1, F.length(c)))


class LoserTree:
    """k sorted iterators merged; after each record one path of log2(k) matches is replayed, against losers only."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [END]
        self.losers = [-1] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            a, b = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple:
        record = next(self.runs[i], None)
        return END if record is None else (0, record)

    def _before(self, a: int, b: int) -> bool:
        return (self.heads[a], a) < (self.heads[b], b)

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not END:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _order(table: pa.Table) -> list[tuple]:
    """Sortable (key, time, id, digest) of each row; a null time, id or digest comes first."""
    held = lambda c: [(v is not None, v if v is not None else 0) for v in table[c].to_pylist()]
    return list(zip(table["key"].to_pylist(), [t or "" for t in table["time"].to_pylist()], held("id"), [d or "" for d in table["digest"].to_pylist()]))


def _sorted_runs(batches):
    from pyspark import TaskContext

    number = 0
    held: list[pa.RecordBatch] = []

    def emit():
        nonlocal number
        table = pa.Table.from_batches(held)
        order = _order(table)
        table = table.take(pa.array(sorted(range(len(order)), key=order.__getitem__), pa.int64()))
        run = TaskContext.get().partitionId() * 1_000_000 + number
        number += 1
        table = table.append_column("run", pa.array(np.full(len(table), run, np.int64))).append_column("seq", pa.array(np.arange(len(table), dtype=np.int64)))
        yield from table.to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= RUN:
            yield from emit()
            held = []
    if held:
        yield from emit()


def _ranged(borders):
    """Adds the range of each record: how many borders are not above it. Runs are sorted, so their parts are cut, not looked up one by one."""

    def run(batches):
        for batch in batches:
            order = _order(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect.bisect_right(borders(), o) for o in order], pa.int32())], [*batch.schema.names, "range"])

    return run


def _segment(table: pa.Table, number: int) -> Iterator[tuple]:
    """The records of a segment in order, as (order, segment, row); a slice at a time is taken apart."""
    for at in range(0, len(table), SLICE):
        part = table.slice(at, SLICE)
        for k, o in enumerate(_order(part)):
            yield o, number, at + k


def _merge(starts):
    """Merge of a range's segments, with each capture's number and whether its payload is that of the one before.

    starts: (captures of the range's first URL before it, digest of the last one) by range, where there are any."""

    def run(batches):
        runs: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:  # sorted by run and place, so segments come one after the other
            cut = [0, *(np.flatnonzero(np.diff(b["run"].to_numpy())) + 1).tolist(), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:]):
                if y > x:
                    runs.setdefault(b["run"][x].as_py(), []).append(b.slice(x, y - x))
        if not runs:
            return
        whole = pa.concat_tables([pa.Table.from_batches(runs[k]) for k in sorted(runs)]).combine_chunks()
        base = np.cumsum([0, *(sum(b.num_rows for b in runs[k]) for k in sorted(runs))])
        segments = [whole.slice(a, b - a) for a, b in zip(base[:-1].tolist(), base[1:].tolist())]
        del runs
        number, digest = starts().get(segments[0]["range"][0].as_py(), (0, None))
        key, out = None, []

        def batch(rows):
            picked = whole.select(["key", "time", "id", "digest", "bytes"]).take(pa.array([base[s] + r for s, r, _, _ in rows]))
            table = pa.Table.from_arrays([*picked.columns, pa.array([n for _, _, n, _ in rows], pa.int64()), pa.array([a for *_, a in rows])], ["url_key", "capture_time", "page_id", "digest", "bytes", "capture", "revisit"])
            yield from table.combine_chunks().to_batches()

        for (own, _, _, mark), segment, row in LoserTree([_segment(s, k) for k, s in enumerate(segments)]):
            if key is not None and own != key:
                number, digest = 0, None
            key, number = own, number + 1
            out.append((segment, row, number, bool(mark) and mark == digest))
            digest = mark
            if len(out) == 10_000:
                yield from batch(out)
                out = []
        if out:
            yield from batch(out)

    return run


def capture_histories(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", time: str = "capture_time") -> DataFrame:
    """(url_key, capture_time, page_id, digest, bytes, capture, revisit), in order of key, time, id and digest.

    ``capture`` numbers the captures of a key from 1; ``revisit`` says that the payload equals that of the capture
    before. A null URL has no key and is left out; a null time or id comes first; a null payload has a null digest and
    is never a revisit; repeated rows are captures of their own. Ids may be of any type that has an order. Other columns
    are ignored whatever their names; an empty table gives an empty result. To the driver come the borders and, for
    URLs that lie on one, their captures by range: a few records for every ``RANGE`` captures.
    """
    rows = only(pages, id=page_id, url=url, payload=payload, time=time)
    kind = type_of(rows, "id")
    index = rows.select(url_key(F.col("url")).alias("key"), F.col("time").cast("string").alias("time"), "id", F.md5(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")).filter("key IS NOT NULL")
    record = f"key string, time string, id {kind}, digest string, bytes long, run long, seq long"
    runs = settle(arrow(index, _sorted_runs, record), "runs")
    count = runs.count()
    parts = parts_for(spark, count, RANGE)
    # About 64 records for each range, by hash, so that reading again draws the same.
    sample = runs.filter(F.pmod(F.xxhash64("key", "time", "id", "digest", "run", "seq"), F.lit(max(1, count // (64 * parts)))) == 0)
    drawn = sorted(_order(sample.select("key", "time", "id", "digest").toArrow()))
    borders = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if drawn else []
    ranged = arrow(runs, _ranged(share(spark, borders)), record + ", range int")
    on_border = sorted({b[0] for b in borders})
    starts: dict[int, tuple[int, str | None]] = {}
    if on_border:
        marked = spark.createDataFrame([(k,) for k in on_border], "key string")
        last = F.max_by("digest", F.struct(F.coalesce("time", F.lit("")), "id", F.coalesce("digest", F.lit(""))))
        by_range = ranged.join(F.broadcast(marked), "key").groupBy("key", "range").agg(F.count("*").alias("n"), last.alias("digest")).orderBy("key", "range").collect()
        key, total, digest = None, 0, None
        for r in by_range:
            if r["key"] != key:
                key, total = r["key"], 0
            elif total:
                starts[r["range"]] = (total, digest)
            total, digest = total + r["n"], r["digest"]
    merged = ranged.repartitionById(parts, F.col("range")).sortWithinPartitions("run", "seq")
    return arrow(merged, _merge(share(spark, starts)), f"url_key string, capture_time string, page_id {kind}, digest string, bytes long, capture long, revisit boolean")


def captures_sql(time: str) -> str:
    c = canonical_sql("url")
    return f"""
WITH named AS (SELECT page_id, html, {time} AS capture_time, {c} AS c FROM pages WHERE url IS NOT NULL),
hosts AS (SELECT *, regexp_extract(c, '^[^/?]*', 0) AS host FROM named),
keyed AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(c, length(host) + 1) AS url_key FROM hosts)
SELECT url_key, capture_time, page_id, md5(html) AS digest, strlen(html) AS bytes, row_number() OVER w AS capture, coalesce(md5(html) = lag(md5(html)) OVER w, false) AS revisit
FROM keyed WINDOW w AS (PARTITION BY url_key ORDER BY coalesce(capture_time, ''), page_id NULLS FIRST, coalesce(md5(html), ''))"""
