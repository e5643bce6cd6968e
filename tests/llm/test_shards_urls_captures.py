"""Sharding, URL filter and capture index against their SQL and against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm import bloom, captures, sharding, urls

from .conftest import rows_of


def plain_jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_matches_plain_version():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 10, 1000, 1_000_000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_appended_shards_move_only_their_part():
    keys = np.random.default_rng(2).integers(0, 2**64, 20_000, dtype=np.uint64)
    a, b = sharding.jump(keys, 50), sharding.jump(keys, 60)
    moved = a != b
    assert (b[moved] >= 50).all() and abs(moved.mean() - 10 / 60) < 0.02
    assert np.bincount(a, minlength=50).min() > 250


def test_shards_match_sql_and_keep_columns(spark, make, messy, duck):
    rows = [(None, "a", "s"), (None, None, None), *messy]
    docs = make(rows)
    out = sharding.assign_shards(docs, 64)
    assert out.columns.count("shard") == 1 and set(out.columns) == set(docs.columns) and out.count() == len(rows)
    assert rows_of(out.select("doc_id", "shard")) == duck(sharding.shards_sql(64), documents=("doc_id BIGINT, text VARCHAR", [(i, t) for i, t, _ in rows]))
    assert sharding.assign_shards(make([]), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, 0)


URLS = [
    "http://www.Example.com/a/?utm_source=x&b=2&a=1#top", "https://example.com:443/a?a=1&b=2", "example.com/a.html?a=1&b=2", "https://m.example.com/b/index.html", "https://example.com/b/", "ftp://user@example.com/c", "", None, "https://other.org", "https://other.org/?ref=z", "http://[::1]/x", "https://other.org/%C3%BC ü",
]


def test_canonical_urls_agree(spark, duck):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = rows_of(pages.select("page_id", urls.canonical(F.col("url")).alias("c")))
    assert got == duck(f"SELECT page_id, {urls.canonical_sql('url')} AS c FROM pages", pages=("page_id BIGINT, url VARCHAR", list(enumerate(URLS))))
    assert len({c for c, i in got if i in (0, 1, 2)}) == 1


@pytest.mark.parametrize("most", [bloom.MOST_BYTES, 32])
def test_url_filter_is_exact(spark, most):
    """With a filter of full size, and with one of a single block that lets most pass; other columns have the names that are used inside."""
    rng = random.Random(4)
    rows = [*enumerate(URLS), *((20 + k, f"https://h{rng.randrange(50)}.net/{rng.randrange(30)}") for k in range(600)), (0, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame([(i, u, "k", True, 1) for i, u in rows], "page_id long, url string, key string, possible boolean, k int")
    listed = spark.createDataFrame([(u, "x") for _, u in rows[:400:3]] + [(None, "x"), (URLS[0], "x")], "url string, key string")
    out = urls.filter_urls(spark, pages, listed, most_bytes=most).collect()
    canonical = dict(pages.select("url", urls.canonical(F.col("url"))).distinct().collect())
    names = {canonical[r["url"]] for r in listed.collect() if r["url"] is not None}
    assert sorted(((r["page_id"], r["canonical_url"], r["listed"]) for r in out), key=repr) == sorted(((i, canonical[u], canonical[u] in names) for i, u in rows), key=repr)
    assert urls.filter_urls(spark, pages.limit(0), listed).count() == 0
    assert not [r for r in urls.filter_urls(spark, pages, listed.limit(0)).collect() if r["listed"]]


def test_bloom_never_misses():
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    held = bloom.BlockedBloom.of(keys[:2500], 2500 * bloom.BITS_A_KEY // 256 + 1)
    assert held.test(keys[:2500]).all() and held.test(keys[2500:]).mean() < 0.02
    for bits in (1, 2, 5):
        small = bloom.BlockedBloom.of(keys[:2500], 40, bits)
        assert small.test(keys[:2500]).all()
    assert bloom.BlockedBloom.of(keys[:2500], 40, 2).test(keys[2500:]).mean() < 0.5


def test_filter_of_bounded_size(spark):
    keys = spark.range(5000)
    held = bloom.build(keys, "id", most_bytes=2048)
    assert held.words.nbytes == 2048 and held.bits == 2
    both = spark.range(10_000).withColumn("may", bloom.may_hold(spark, held, F.col("id")))
    assert both.filter("id < 5000 AND may").count() == 5000 and both.filter("id >= 5000 AND may").count() < 3000
    assert not bloom.build(keys.limit(0), "id").test(np.arange(3, dtype=np.uint64)).any()


def test_loser_tree_merges():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(30), r, n) for n in range(rng.randrange(20))) for r in range(k)]
        assert list(captures.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


@pytest.mark.parametrize("most", [captures.RANGE, 15])
def test_captures_match_sql_in_order(spark, duck, monkeypatch, most):
    """In many runs, and with ranges so small that each URL lies in several."""
    monkeypatch.setattr(captures, "RUN", 50)
    monkeypatch.setattr(captures, "RANGE", most)
    rng = random.Random(7)
    rows = [(None if k % 41 == 0 else k % 190, None if k % 37 == 0 else f"http://h{rng.randrange(6)}.org/{rng.randrange(8)}", None if k % 29 == 0 else f"p{rng.randrange(3)}", None if k % 23 == 0 else f"2024{rng.randrange(9)}", "c") for k in range(400)]
    schema = "page_id long, url string, html string, capture_time string, key string"
    pages = spark.createDataFrame(rows, schema).repartition(5)
    got = captures.capture_histories(spark, pages).collect()
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got)
    assert len(got) == sum(r[1] is not None for r in rows)
    plain = sorted((r["url_key"], r["capture_time"] or "", -1 if r["page_id"] is None else r["page_id"]) for r in got)
    assert [(r["url_key"], r["capture_time"] or "", -1 if r["page_id"] is None else r["page_id"]) for r in got] == plain
    for a, b in zip(got, got[1:]):
        same = a["url_key"] == b["url_key"]
        assert b["capture"] == (a["capture"] + 1 if same else 1) and b["revisit"] == (same and a["digest"] is not None and a["digest"] == b["digest"])
    unique = {(r[1], r[3], r[0]): r for r in rows}
    table = [r[:4] for r in unique.values()]
    again = captures.capture_histories(spark, spark.createDataFrame([(*r, "c") for r in table], schema))
    assert rows_of(again) == duck(captures.captures_sql("capture_time"), pages=("page_id BIGINT, url VARCHAR, html VARCHAR, capture_time VARCHAR", table))
    assert captures.capture_histories(spark, pages.limit(0)).count() == 0


def test_a_hot_url_is_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(captures, "RANGE", 100)
    rows = [(f"id{k:04d}", "http://hot.org/x" if k % 3 else f"http://h{k}.org/{'y' * 5000}", f"p{k // 10}", f"{k:05d}", 1) for k in range(1500)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, capture_time string, key int").repartition(7)
    out = captures.capture_histories(spark, pages)
    got = out.collect()
    assert out.rdd.getNumPartitions() >= 15 and [r["url_key"] for r in got] == sorted(r["url_key"] for r in got)
    hot = [r for r in got if r["url_key"] == "org,hot)/x"]
    assert [r["page_id"] for r in hot] == [r[0] for r in rows if r[1] == "http://hot.org/x"] and [r["capture"] for r in hot] == list(range(1, 1001))
    assert [r["revisit"] for r in hot] == [False, *(a["digest"] == b["digest"] for a, b in zip(hot, hot[1:]))]
