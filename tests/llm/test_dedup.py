"""Line, exact and near dedup against their SQL, on tables with every odd case."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import exact, jaccard, lines
from tesselon.llm.queries import LINES, NEAR

from .conftest import rows_of, words

DOCS = "doc_id BIGINT, text VARCHAR"


def pairs_of(rows):
    return [(i, t) for i, t, _ in rows]


def unique(rows):
    return sorted({(i, t) for i, t, _ in rows if i is not None}, key=repr)


def test_lines_match_sql(spark, make, messy, duck):
    got = rows_of(lines.dedup_lines(spark, make(messy), **LINES).distinct())
    assert got == duck(lines.lines_sql(**LINES), documents=(DOCS, unique(messy)))
    cut = {r["doc_id"]: r for r in lines.dedup_lines(spark, make(messy), **LINES).collect()}
    assert cut[2]["removed_lines"] == 1 and cut[8]["removed_lines"] >= 1 and cut[-4]["removed_lines"] == 0
    assert cut[5]["text"] is None and cut[4]["text"] == "" and cut[13]["text"] == "same"


@pytest.mark.parametrize("hashed", [True, False])
def test_lines_of_few_words_match_sql(spark, make, duck, monkeypatch, hashed):
    """Short lines of a small vocabulary, blank ones among them; and with keys that many chunks share, told apart by their bytes."""
    if not hashed:
        real = lines.Lines.chunks
        monkeypatch.setattr(lines.Lines, "chunks", lambda self: (real(self)[0] % lines.U(7), *real(self)[1:]))
    rng = random.Random(9)
    rows = [(k, "\n".join(rng.choice(["", " ", "a", "b", "c d", "e" * rng.randrange(9), "ü", words(rng, 60, 3)]) for _ in range(rng.randrange(12))), "s") for k in range(120)]
    rows += [(200, "", "s"), (201, "\n\n\n", "s"), (202, "a\n\n\nb", "s"), (203, "x\n" * 3000 + "a\n\n\nb", "s"), (204, "a\n\n\nb\n", "s")]
    got = rows_of(_lines_here(spark, rows) if not hashed else lines.dedup_lines(spark, make(rows), **LINES))
    assert got == duck(lines.lines_sql(**LINES), documents=(DOCS, pairs_of(rows)))


def _lines_here(spark, rows):
    """The steps of ``dedup_lines`` with the keys of this process, since workers don't see what a test replaces."""
    import types

    frame = pa.table([pa.array([i for i, *_ in rows], pa.int64()), pa.array([t for _, t, _ in rows])], ["doc", "text"]).to_batches()
    every = types.SimpleNamespace(test=lambda key: np.ones(len(key), bool))
    table = pa.Table.from_batches(lines._bodies(50, lambda: every)(iter(frame)))
    bodies = spark.createDataFrame([(r["key"], r["doc"], r["i"], r["body"]) for r in table.to_pylist()], "key long, doc long, i int, body binary")
    drops = {r["doc"]: r["drops"] for r in lines.later_places(bodies).collect()}
    out = []
    for i, t, _ in rows:
        text, removed = lines.cleaned(pa.array([t]), pa.array([[{"i": d["i"], "key": d["key"]} for d in drops[i]] if i in drops else None], pa.list_(pa.struct([("i", pa.int32()), ("key", pa.int64())]))), 50)
        out.append((i, int(removed[0]), text[0].as_py()))
    return spark.createDataFrame(out, "doc_id long, removed_lines int, text string")


def test_passages_of_several_short_lines_go(spark, make):
    """Of passages of more than 50 words on lines of 9 to 30, at any place among other lines, only the first stays."""
    rng = random.Random(14)
    passages = [[words(rng, n) for n in sizes] for sizes in ((30, 25), (20, 20, 15), (9,) * 7, (49, 3), (12, 40))]
    rows = []
    for k in range(60):
        own = [words(rng, rng.randrange(3, 20)) for _ in range(rng.randrange(1, 8))]
        at = rng.randrange(len(own) + 1)
        rows.append((k, "\n".join([*own[:at], *passages[k % 5], *own[at:]]), "s"))
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark, make(rows), **LINES).collect()}
    for k, text, _ in rows:
        passage = passages[k % 5]
        assert out[k]["removed_lines"] == (len(passage) if k >= 5 else 0)
        assert out[k]["text"] == (text if k < 5 else "\n".join(x for x in text.split("\n") if x not in passage))


def test_lines_with_ids_of_text(spark, make):
    rng = random.Random(15)
    shared = "\n".join(words(rng, 20) for _ in range(4))
    docs = spark.createDataFrame([(f"urn:{k}", f"own {k}\n{shared}") for k in "cabd"], "doc_id string, text string")
    assert {r["doc_id"]: r["removed_lines"] for r in lines.dedup_lines(spark, docs, **LINES).collect()} == {"urn:a": 0, "urn:b": 4, "urn:c": 4, "urn:d": 4}


def test_lines_null_id_passes_and_empty_table(spark, make, messy):
    rows = [(None, messy[8][1], "s0"), *messy]
    out = [r for r in lines.dedup_lines(spark, make(rows), **LINES).collect() if r["doc_id"] is None]
    assert [(r["text"], r["removed_lines"]) for r in out] == [(messy[8][1], 0)]
    assert lines.dedup_lines(spark, make([]), **LINES).count() == 0


def test_chunks_resist_shifts(spark, make):
    rng = random.Random(3)
    shared = [words(rng, 9) for _ in range(60)]
    rows = [(1, "\n".join(shared), "s"), (2, "\n".join([words(rng, 9), words(rng, 9), words(rng, 9), *shared]), "s")]
    out = {r["doc_id"]: r["removed_lines"] for r in lines.dedup_lines(spark, make(rows), **LINES).collect()}
    assert out[1] == 0 and out[2] >= 35


def test_long_passages_go_wherever_they_stand(spark, make):
    rng = random.Random(4)
    passage = words(rng, 55)
    rows = [(k, "\n".join([words(rng, rng.randrange(3, 70)), words(rng, 5), passage, words(rng, rng.randrange(3, 30))]), "s") for k in range(30)]
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark, make(rows), **LINES).collect()}
    assert [k for k in out if passage in out[k]["text"]] == [0] and all(out[k]["removed_lines"] == (k > 0) for k in out)


def test_exact_matches_sql(spark, make, messy, duck):
    rows = [*messy, (None, messy[0][1], "s0"), (None, None, None)]
    assert rows_of(exact.exact_duplicates(spark, make(rows))) == duck(exact.EXACT_SQL, documents=(DOCS, pairs_of(rows)))
    assert exact.exact_duplicates(spark, make([])).count() == 0


def test_exact_texts_under_clashing_ids(spark, make, duck):
    """An id with two texts of equal length, both with copies elsewhere."""
    rows = [(1, "abc", "s"), (1, "xyz", "s"), (2, "abc", "s"), (3, "xyz", "s"), (4, "xyz", "s"), (5, "abc", "s"), (5, "xyz", "s"), (6, "own", "s")]
    assert rows_of(exact.exact_duplicates(spark, make(rows))) == duck(exact.EXACT_SQL, documents=(DOCS, pairs_of(rows)))


def test_fingerprints_combine():
    rng = np.random.default_rng(1)
    for n, cut in ((1, 0), (5000, 1024), (70_000, 33_333), (3, 3)):
        data = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        part = lambda b: (*exact.fingerprints(pa.array([b], pa.binary()))[0].tolist(), len(b))
        assert exact.combine(part(data[:cut]), part(data[cut:])) == part(data)


@pytest.mark.parametrize("piece", [exact.PIECE, 1000])
def test_huge_texts_in_pieces(spark, make, duck, monkeypatch, piece):
    """Texts cut into many pieces, hashed apart and combined, beside short ones; one group of many documents."""
    monkeypatch.setattr(exact, "PIECE", piece)
    monkeypatch.setattr(exact, "TOGETHER", 7)
    rng = random.Random(18)
    big = words(rng, 60_000)
    rows = [(1, big, "s"), (2, big[:-1] + "#", "s"), (3, big, "s"), (4, big[:500_000], "s"), (4, big, "s"), (5, "#" + big[1:], "s"), (6, "", "s"), (7, "ü" * 999 + "x", "s"), (8, "ü" * 999 + "x", "s"), *((100 + k, "the same", "s") for k in range(500))]
    assert rows_of(exact.exact_duplicates(spark, make(rows))) == duck(exact.EXACT_SQL, documents=(DOCS, pairs_of(rows)))


def test_native_fold_is_combine(spark):
    rng = np.random.default_rng(5)
    data = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1000, 1, 5000, 777)]
    prints = pa.Table.from_batches(exact._piece_prints(iter([pa.RecordBatch.from_arrays([pa.array([0] * 4), pa.array([0] * 4), pa.array(range(4), pa.int32()), pa.array(data)], ["doc", "row", "i", "data"])])))
    rows = [tuple(r[c] for c in ("i", "f1", "f2", "w1", "w2", "bytes")) for r in prints.to_pylist()]
    df = spark.createDataFrame([(rows,)], "p array<struct<i int, f1 long, f2 long, w1 long, w2 long, bytes long>>")
    found = df.select(exact.combined(F.col("p")).alias("m")).first()["m"]
    whole = b"".join(data)
    assert tuple(found) == (*exact.fingerprints(pa.array([whole], pa.binary()))[0].tolist(), len(whole))


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("urn:uuid:b", "one two three four five six"), ("urn:uuid:a", "one two three four five six"), ("c", "one two three four five seven"), ("d", ""), (None, "x"), ("e", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["kept_id"], r["copies"]) for r in exact.exact_duplicates(spark, docs).collect()} == {("urn:uuid:a", "urn:uuid:a", 2), ("urn:uuid:b", "urn:uuid:a", 2), ("c", "c", 1), ("d", "d", 1)}
    found = {(r["doc_id"], r["class_id"], r["links"], r["best"]) for r in jaccard.ngram_jaccard_join(spark, docs, n=3, threshold=0.5).collect()}
    assert found == {("urn:uuid:a", "c", 2, 1.0), ("urn:uuid:b", "c", 2, 1.0), ("c", "c", 2, 0.6), ("d", "d", 0, None)}
    assert sorted(r["doc_id"] or "" for r in jaccard.one_of_each_group(spark, docs, n=3).collect()) == ["", "c", "d", "e"]


def test_equal_fingerprints_are_compared(spark, make, monkeypatch):
    """Texts whose fingerprints are all made equal are still told apart by their bytes."""
    rng = random.Random(8)
    a = words(rng, 30_000)
    rows = [(1, a, "s"), (2, a[:-1] + "#", "s"), (3, a, "s"), (4, "#" + a[1:], "s")]
    real = exact._piece_prints

    def blind(batches):
        for b in real(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(np.zeros(len(b), np.int64)) for _ in range(5))], b.schema.names)

    monkeypatch.setattr(exact, "_piece_prints", blind)
    out = {r["doc_id"]: (r["kept_id"], r["copies"]) for r in exact.exact_duplicates(spark, make(rows)).collect()}
    assert out == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_jaccard_matches_sql(spark, make, messy, duck):
    got = rows_of(jaccard.ngram_jaccard_join(spark, make([(None, messy[0][1], "s"), *messy]), **NEAR))
    assert got == duck(jaccard.ngram_jaccard_sql(**NEAR), documents=(DOCS, unique(messy)))
    found = {r[2]: r for r in got}
    assert found[1][3] == found[2][3] == found[3][3] == 2 and found[3][1] == 1 and found[12][0] is None
    assert jaccard.ngram_jaccard_join(spark, make([]), **NEAR).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_jaccard_near_copies(spark, make, duck, threshold):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = words(rng, rng.randrange(20, 200), 300).split()
        for c in range(rng.randrange(1, 9)):
            own = [w if rng.random() > 0.02 * c else f"z{rng.randrange(50)}" for w in base]
            rows.append((len(rows), " ".join(own), "s"))
    got = rows_of(jaccard.ngram_jaccard_join(spark, make(rows), n=3, threshold=threshold))
    assert got == duck(jaccard.ngram_jaccard_sql(3, threshold), documents=(DOCS, pairs_of(rows))) and sum(r[3] for r in got) > 10


def test_jaccard_short_near_copies(spark, make, duck):
    """Texts of 5 to 19 words, whose sets hold fewer n-grams than twice the most matches."""
    rng = random.Random(21)
    rows = []
    for size in range(5, 20):
        for _ in range(6):
            base = words(rng, size, 300).split()
            cut, tail = rng.randrange(0, 4), rng.randrange(0, 4)
            for own in (base, [*base, "z1"], ["z2", *base, "z3"], base[cut:], base[: len(base) - tail]):
                rows.append((len(rows), " ".join(own), "s"))
    got = rows_of(jaccard.ngram_jaccard_join(spark, make(rows), **NEAR))
    assert got == duck(jaccard.ngram_jaccard_sql(**NEAR), documents=(DOCS, pairs_of(rows)))
    assert sum(r[0] is not None and r[0] < 1 for r in got) >= 50


@pytest.mark.parametrize("frequent", [10**9, 2])
def test_jaccard_large_group(spark, make, duck, monkeypatch, frequent):
    """A third of the rows near copies of one text, another third exact copies; lists cut into cells, with n-grams known to be frequent or not."""
    monkeypatch.setattr(jaccard, "LIST", 16)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SAMPLE", 4)
    rng = random.Random(23)
    base, other = words(rng, 60).split(), words(rng, 40)
    rows = [(k, " ".join(w if rng.random() > 0.01 else f"z{rng.randrange(99)}" for w in base), "s") for k in range(150)]
    rows += [(1000 + k, other, "s") for k in range(150)] + [(2000 + k, words(rng, 30, 50), "s") for k in range(100)]
    rows += [(3000, "boiler plate text of the site " + words(rng, 50), "s"), (3001, "boiler plate text of the site " + words(rng, 8), "s")]
    got = rows_of(jaccard.ngram_jaccard_join(spark, make(rows), **NEAR))
    assert got == duck(jaccard.ngram_jaccard_sql(**NEAR), documents=(DOCS, pairs_of(rows))) and len(got) == len(rows)


def test_jaccard_long_words_and_clashing_ids(spark, make, duck):
    """A word of more than 65,536 letters, with and without a space after it; ids with two texts, one of them a near copy elsewhere."""
    rng = random.Random(24)
    a, b = words(rng, 40), words(rng, 40)
    long = "z" * 65_536
    rows = [(1, long + "a b c d e f", "s"), (2, long + " a b c d e f", "s"), (3, a, "s"), (3, b, "s"), (4, a + " tail", "s"), (5, "head " + b, "s"), (5, "head " + b, "s"), (6, "x", "s"), (6, "x", "s")]
    got = rows_of(jaccard.ngram_jaccard_join(spark, make(rows), **NEAR))
    assert got == duck(jaccard.ngram_jaccard_sql(**NEAR), documents=(DOCS, pairs_of(rows)))
    kept = sorted((r["doc_id"], r["text"][:5]) for r in jaccard.one_of_each_group(spark, make(rows), **NEAR).collect())
    assert len(kept) == 6 and [i for i, _ in kept] == [1, 2, 3, 3, 6, 6]


def test_one_of_each_group(spark, make, messy):
    rows = [(None, "no id " + messy[0][1], "s"), *messy]
    docs = make(rows).withColumnRenamed("value", "_gone")
    kept = jaccard.one_of_each_group(spark, docs, **NEAR)
    assert kept.columns == docs.columns
    first = {r["doc_id"] for r in jaccard.ngram_jaccard_join(spark, docs, **NEAR).collect() if r["class_id"] == r["doc_id"]}
    # Of the repeated row 2, both are near copies of 1; texts that are null stay.
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([None, 5, *first], key=repr)
    assert jaccard.one_of_each_group(spark, make([]), **NEAR).count() == 0


def test_rows_grow_as_documents(spark, make):
    rows = [(k, "one and the same text for every one of them", "s") for k in range(3000)]
    out = jaccard.ngram_jaccard_join(spark, make(rows), **NEAR).groupBy("class_id", "links", "best").count().collect()
    assert [tuple(r) for r in out] == [(0, 2999, 1.0, 3000)]
