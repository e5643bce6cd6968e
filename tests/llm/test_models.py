"""Classifier by held-out accuracy, decontamination and licences against brute force, mixing by round trips, the pipeline as a whole."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import classifier, decontaminate, licences, mixing
from tesselon.llm.textkit import Words

from .conftest import SCHEMA, rows_of, words


def labelled(n, seed=1):
    """Good prose, junk (repeats and shouting), and toxic prose of which one passage alone has the marked words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        text = words(rng, rng.randrange(60, 400))
        if kind == 1:
            junk = [rng.choice(["click", "buy", "now", "!!!", "free", "$$$"]) for _ in range(80)]
            text = " ".join(w for pair in zip(text.split(), junk) for w in pair)
        if kind == 2:
            own = text.split()
            at = rng.randrange(len(own) - 20)
            for k in range(0, 16, 3):
                own[at + k] = rng.choice(["vile", "slur", "hateful", "scum"])
            text = " ".join(own)
        docs.append((i, text, f"s{i % 4}"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    m = classifier.Model()
    for name in ("b", "v", "u", "w", "c", "d"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    sums, passages, y = rng.normal(size=(7, classifier.WIDTH)), np.array([1, 4, 2]), rng.integers(0, 2, (3, 2))
    weight = rng.uniform(0.5, 2, (3, 2))

    def loss():
        p = m.bags(sums, passages)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads, dsum = m.gradients(m.bags(sums, passages), y, weight)
    for value, grad in [(getattr(m, n), g) for n, g in zip(("b", "v", "u", "w", "c", "d"), grads)] + [(sums, dsum)]:
        for at in list(np.ndindex(value.shape))[::7]:
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_held_out_accuracy(spark, make):
    docs, labels = labelled(900)
    held, wanted = labelled(300, seed=99)
    held = [(10_000 + i, t, s) for i, t, s in held]
    out = {r["doc_id"]: r for r in classifier.classify(spark, make(docs + held), spark.createDataFrame(labels, LABELS)).collect()}
    for column, k in (("quality", 1), ("toxic", 2)):
        right = np.mean([(out[10_000 + w[0]][column] >= 0.5) == bool(w[k]) for w in wanted])
        assert right >= 0.95, (column, right)
    assert all(out[i]["passages"] == -(-len(t.split()) // classifier.PASSAGE) for i, t, _ in held if "!" not in t)


def test_scores_match_a_plain_version(spark, make, messy):
    """Features, passages, gated attention and logits of the fitted model, document by document in plain Python."""
    docs, labels = labelled(150)
    marks = spark.createDataFrame(labels, LABELS)
    model = classifier.train(spark, make(docs), marks)
    table = {int(k): v.astype(float) for k, v in zip(model.keys[:-1], model.table)}
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def plain(text):
        own = Words(pa.array([text]), prefixes=classifier.PREFIXES, gaps=8)
        n, encoded = len(own.hash), []
        for at in range(0, n, classifier.PASSAGE) or (0,):
            total = np.zeros(classifier.WIDTH)
            for w in range(at, min(n, at + classifier.PASSAGE)):
                kinds = [own.hash[w], *(own.prefix[p][w] for p in classifier.PREFIXES), own.gap[w]] + [classifier.AGAIN] * int(w > 0 and own.hash[w] == own.hash[w - 1])
                for k in kinds:
                    total += table.get(int(k), 0)
            encoded.append(np.tanh(total / np.sqrt(max(1, min(classifier.PASSAGE, n - at))) + model.b))
        h, out = np.stack(encoded), []
        for t in (0, 1):
            e = np.array([(np.tanh(x @ model.v) * sig(x @ model.u)) @ model.w[:, t] for x in h])
            alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            out.append(float(sig((alpha[:, None] * h).sum(0) @ model.c[t] + model.d[t])))
        return out

    rows = [*docs[:40], *((9000 + k, t, s) for k, (_, t, s) in enumerate(messy))]
    got = {r["doc_id"]: r for r in classifier.classify(spark, make(docs + rows[40:]), marks).collect()}
    for i, text, _ in rows:
        if text is not None:
            assert (got[i]["quality"], got[i]["toxic"]) == pytest.approx(tuple(plain(text)), abs=2e-4)
    strict = {r["doc_id"] for r in classifier.keep_good(spark, make(docs), marks, quality=0.9, toxic=0.1).collect()}
    assert strict == {r["doc_id"] for r in classifier.classify(spark, make(docs), marks, quality=0.9, toxic=0.1).collect() if r["keep"]}


def test_odd_rows_are_scored(spark, make, messy):
    docs, labels = labelled(120)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (4, 1, None), (5, 0, 1), (5, 0, 1), (99_999, 1, 0)], LABELS)
    rows = [(None, "no id", "s"), *messy, *docs]
    out = classifier.classify(spark, make(rows), marks).collect()
    assert len(out) == len(rows)
    assert [(r["quality"], r["toxic"], r["keep"]) for r in out if r["doc_id"] == 5 and r["passages"] == 0] == [(None, None, False)]
    kept = classifier.keep_good(spark, make(rows), marks)
    assert kept.columns == make(rows).columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in out if r["keep"])
    none = classifier.classify(spark, make(messy), marks.limit(0)).collect()
    assert {(r["quality"], r["toxic"]) for r in none if r["keep"]} == {(0.5, 0.5)} and sum(r["keep"] for r in none) == len(messy) - 1
    assert classifier.classify(spark, make([]), marks).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate._masks(np.array(a)), len(a), b) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def leaked():
    """Documents with items word for word, paraphrased, or not at all, at any place."""
    rng = random.Random(12)
    items = [(k, words(rng, rng.choice([14, 25, 40, 60, 110]))) for k in range(12)]
    docs, truth = [], set()
    for i in range(150):
        body = words(rng, rng.randrange(20, 500)).split()
        if i % 3 == 0:
            k = rng.randrange(len(items))
            own = items[k][1].split()
            if i % 2:
                own = [w for j, w in enumerate(own) if j % 9 != 4]  # every ninth word is left out
            at = rng.randrange(len(body))
            body[at:at] = own
            truth.add((i, k))
        docs.append((i, " ".join(body), "s"))
    return items, docs, truth


def test_leaks_are_found_and_only_they(spark, make, leaked):
    items, docs, truth = leaked
    found = decontaminate.find_leaks(spark, make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    brute = {(d, k) for d, text, _ in docs for k, item in items if plain_lcs(item.split(), text.split()) >= 0.8 * len(item.split())}
    assert len(pairs & brute) >= 0.95 * len(brute) and truth <= brute and not pairs - brute
    kept = decontaminate.without_leaks(spark, make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in pairs} and kept.columns == make(docs).columns


def test_reworded_and_short_leaks_are_found(spark, make):
    """Items of which up to 45 % of the words before the answer are replaced: recall of those the rule accepts, by length."""
    rng = random.Random(31)
    items, docs, truth = [], [], {}
    for n in (2, 3, 5, 8, 12, 15, 20, 38, 59, 90):
        for _ in range(3):
            item = words(rng, n).split()
            items.append((len(items), " ".join(item)))
            closing = max(3, n // 5)
            for share in (0, 0.2, 0.3, 0.4, 0.45) * 3:
                own = list(item)
                for j in rng.sample(range(max(0, n - closing)), min(max(0, n - closing), int(share * n))):
                    own[j] = words(rng, 1)
                host = words(rng, rng.randrange(60, 300)).split()
                at = rng.randrange(len(host))
                if plain_lcs(item, own) >= 0.55 * n - 1e-9:
                    truth.setdefault(n, []).append((len(docs), items[-1][0]))
                docs.append((len(docs), " ".join([*host[:at], *own, *host[at:]]), "s"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {n: sum(p in found for p in pairs) / len(pairs) for n, pairs in truth.items()}
    assert len(truth) == 10 and min(recall.values()) >= 0.9, recall


def test_space_agrees_with_an_exact_decomposition(spark, make):
    """The sketched space holds the leading singular vectors of the whole passage matrix, and is whitened over all passages."""
    rng = random.Random(51)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(12)]
    docs = [(i, " ".join(rng.choice(topics[i % 12]) for _ in range(160)), "s") for i in range(240)]
    space = decontaminate.latent_space(spark, make(docs).select("text"))
    passages = [" ".join(t.split()[k : k + decontaminate.PASSAGE]) for _, t, _ in docs for k in range(0, 160, decontaminate.PASSAGE)]
    counts = np.zeros((len(passages), decontaminate.TERMS))
    for k, p in enumerate(passages):
        np.add.at(counts[k], decontaminate.terms(Words(pa.array([p]))), 1)
    used = np.flatnonzero(counts.any(0))
    idf = np.log((len(passages) + 1) / ((counts[:, used] > 0).sum(0) + 1))
    _, _, v = np.linalg.svd(counts[:, used] * idf, full_matrices=False)
    basis, _ = np.linalg.qr(space[used] / idf[:, None])
    held = np.linalg.norm(basis.T @ v[:12].T, axis=0)  # how much of each leading singular vector lies in the sketched space
    assert held.min() > 0.95
    own = counts @ space[:-1]
    assert np.abs(own.T @ own / len(passages) - np.eye(space.shape[1])).max() < 0.05  # of unit variance in every direction


def test_moved_clauses_and_parts_of_a_benchmark(spark, make, monkeypatch):
    """Items of which a clause before the answer stands elsewhere, searched for in a benchmark that takes several passes."""
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 600)
    rng = random.Random(52)
    items = [(f"q{k}", words(rng, 40)) for k in range(12)]
    docs = []
    for k, (_, text) in enumerate(items):
        own = text.split()
        moved = own[8:16] + own[:8] + own[16:]
        docs.append((k, " ".join([words(rng, 60), *moved, words(rng, 60)]), "s"))
    docs += [(100 + k, words(rng, 200), "s") for k in range(30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, make(docs), bench).collect()}
    assert found == {(k, f"q{k}") for k in range(12)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(spark, make(docs), bench).collect()} == {100 + k for k in range(30)}


def test_sums_have_64_bits(spark):
    from tesselon.llm.common import blobs, summed

    def part(batches):
        for _ in batches:
            yield blobs(np.array([2_000_000_000, 5], np.int64))

    frame = spark.range(2, numPartitions=2).mapInArrow(part, "part int, blob binary")
    assert summed(frame, 2, np.int64).tolist() == [4_000_000_000, 10]
    with pytest.raises(TypeError):
        summed(frame, 2, np.int32)


def test_odd_rows_of_both_sides(spark, make, messy, leaked):
    items, docs, _ = leaked
    rows = [(None, items[0][1] + " tail", "s"), *messy, *docs]
    bench = spark.createDataFrame([*items, (items[0][0], items[0][1]), (50, items[0][1]), (51, None), (None, "a b c"), (52, ""), (53, "?!")], "item_id long, text string").withColumn("doc", F.lit(1)).withColumn("item", F.lit("x"))
    out = decontaminate.find_leaks(spark, make(rows), bench).collect()
    assert {r["item_id"] for r in out if r["doc_id"] is None} == {0, 50}
    assert decontaminate.find_leaks(spark, make([]), bench).count() == 0
    assert decontaminate.find_leaks(spark, make(rows), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(spark, make(messy), bench.limit(0)).count() == len(messy)


def test_licences_match_brute_force(spark, make):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lines = [words(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 8))]
        if i % 2:
            text = rng.choice(licences.TEMPLATES)[1].split()
            if i % 4 == 1 and len(text) > 6:
                text[rng.randrange(len(text))] = "other"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(text))
        rows.append((i, "\n".join(lines), "s"))
    texts = [t for _, t, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    sums = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in next(licences._frequencies([batch])).column(1)])
    df = np.zeros(1 << licences.SLOTS, int)
    for t in texts:
        df[np.unique(licences.slots(Words(pa.array([t]))))] += 1
    assert (sums[:-1] == df).all() and sums[-1] == len(texts)
    idf = 1 + np.log((1 + len(texts)) / (1 + df))

    def vector(terms):
        v = np.zeros(1 << licences.SLOTS)
        np.add.at(v, terms, idf[terms])
        return v

    expected = {}
    templates = [(n, licences.slots(Words(pa.array([t])))) for n, t in licences.TEMPLATES]
    for i, text, _ in rows:
        at, each = licences.slots(Words(pa.array([text]))), {}
        for number, (name, own) in enumerate(templates):
            t = vector(own)
            for k in range(len(at)):
                if at[k] in own:
                    w = at[k : k + len(own)]
                    u, c = np.unique(w, return_counts=True)
                    cosine = round(float((c * idf[u] * t[u]).sum() / np.sqrt(((c * idf[u]) ** 2).sum()) / np.sqrt((t**2).sum())), 6)
                    if cosine >= 0.8:
                        each[number] = max(cosine, each.get(number, 0))
        near = [n for n in each if each[n] >= max(each.values()) - licences.NEAR - 1e-6]
        best = max(near, key=lambda n: (len(templates[n][1]), round(each[n], 5), -n), default=None)
        expected[i] = (0.0, None) if best is None else (each[best], templates[best][0])
    docs = make(rows).withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    got = {r["doc_id"]: r for r in licences.scan_licences(spark, docs).collect()}
    for i, (cosine, name) in expected.items():
        assert got[i]["licence"] == name and (name is None or abs(got[i]["similarity"] - cosine) < 1e-5)
    assert sum(n is not None for _, n in expected.values()) >= 50


def test_whole_licence_texts_are_told_apart(spark, make):
    texts = {n: t for n, t in licences.TEMPLATES if n.startswith("BSD-") and len(t) > 200}
    reflowed = {n: "Copyright (c) 2019 Somebody\n" + t.replace(": Redistributions", ":\n\n1. Redistributions").replace(". Redistributions in", ".\n2. Redistributions in") for n, t in texts.items()}
    rows = [(k, t, "s") for k, t in enumerate([*texts.values(), *reflowed.values()])]
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(spark, make(rows).withColumn("path", F.lit("x"))).collect()}
    assert [got[k] for k in range(4)] == [*texts, *reflowed]


def test_nearest_ancestor_gives_the_licence(spark, make):
    mit, gpl = "Released under the MIT License.", next(t for n, t in licences.TEMPLATES if n == "GPL-3.0")
    files = {"LICENSE": mit, "a/b/COPYING": gpl, "a/b/c/x.txt": "plain words here", "a/y.txt": "other words there", "z.txt": None, "a/b/c/own.py": "# " + mit + "\ncode", "q/LICENSE.md": "no terms at all", "q/w.txt": "", "a/bb/v.txt": "words", "a/b/notes": gpl}
    rows = [(i, t, "s") for i, t in enumerate(files.values())]
    paths = spark.createDataFrame(list(enumerate(files)), "doc_id long, path string")
    docs = make([*rows, (90, "no path", "s"), (2, files["a/b/c/x.txt"], "s"), (None, mit, "s")]).join(paths, "doc_id", "left")
    got = licences.scan_licences(spark, docs).collect()
    by = {r["path"]: (r["licence"], r["basis"], r["licensed_by"]) for r in got if r["path"]}
    assert by == {
        "LICENSE": ("MIT", "own", None), "a/b/COPYING": ("GPL-3.0", "own", None), "a/b/c/x.txt": ("GPL-3.0", "inherited", "a/b"), "a/y.txt": ("MIT", "inherited", ""), "z.txt": ("MIT", "inherited", ""), "a/b/c/own.py": ("MIT", "own", None),
        "q/LICENSE.md": ("MIT", "inherited", ""), "q/w.txt": ("MIT", "inherited", ""), "a/bb/v.txt": ("MIT", "inherited", ""), "a/b/notes": ("GPL-3.0", "own", None),
    }
    assert len(got) == len(rows) + 3
    assert sorted((r["licence"] is None, r["doc_id"] is None) for r in got if r["path"] is None) == [(False, True), (True, False)]
    assert licences.scan_licences(spark, docs.limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        found = mixing.permute(np.arange(n), n, 12345)
        assert sorted(found.tolist()) == list(range(n))
        assert n < 10 or (mixing.permute(np.arange(n), n, 54321) != found).any()


def test_blocks_round_trip(spark, make, messy):
    """Every block is drawn whole; taken once each and in order, blocks give back their bucket's texts."""
    rows = [(None, "no id here", "s0"), *messy]
    got = mixing.mix_sources(spark, make(rows), block=64, weights={"s0": 1.0}, slots=8000).collect()
    assert {r["source"] for r in got} == {"s0"}
    blocks: dict = {}
    for r in got:
        blocks.setdefault((r["shard"], r["slot"]), []).append(r)
    assert all(sum(p["tokens"] for p in sorted(b, key=lambda p: p["first"])[:k]) == p["first"] for b in blocks.values() for k, p in enumerate(sorted(b, key=lambda p: p["first"])))
    assert len(blocks) == 8000
    whole = {tuple((p["first"], p["doc_id"], p["text"]) for p in sorted(b, key=lambda p: p["first"])) for b in blocks.values()}
    sizes = [sum(p["tokens"] for p in b) for b in blocks.values()]
    assert max(sizes) == 64 and len({tuple(sorted((p["first"], p["doc_id"] or 0, p["text"]) for p in b)) for b in blocks.values() if sum(p["tokens"] for p in b) < 64}) <= 1
    texts = [t for i, t, s in rows if s == "s0" and t and t.split()]
    assert len(whole) == -(-sum(len(t.split()) for t in texts) // 64)  # all of them, as 8000 draws are several epochs
    assert sum(len(text) for b in whole for _, _, text in b) == sum(map(len, texts))
    by_doc = {i: t for i, t, s in rows if s == "s0" and t and t.split()}
    for b in whole:
        for _, i, text in b:
            assert text in by_doc[i]
    by_epoch: dict = {}
    for key, b in blocks.items():
        by_epoch.setdefault(b[0]["epoch"], []).append(tuple((p["doc_id"], p["text"]) for p in sorted(b, key=lambda p: p["first"])))
    for epoch in range(max(by_epoch)):
        assert len(set(by_epoch[epoch])) == len(by_epoch[epoch]) == len(whole)


@pytest.mark.parametrize("size", [mixing.BUCKET_BYTES, 3000])
def test_mixing_matches_a_plain_version(spark, make, messy, monkeypatch, size):
    """Draws, permutations and the join of slots and blocks, against loops over one list of tokens a source."""
    monkeypatch.setattr(mixing, "BUCKET_BYTES", size)
    rng = random.Random(41)
    rows = [*messy, (None, "no id here", "s0"), (None, "no id there", "s1"), *((500 + k, words(rng, rng.randrange(1, 90)), f"s{k % 2}") for k in range(60))]
    rows = [r for r in rows if r[2] is not None]
    weights, block, slots, a_shard, seed = {"s0": 0.5, "s1": 0.2, "s2": 0.3}, 32, 700, 200, 11
    got = sorted(((r["shard"], r["slot"], r["first"], r["doc_id"], r["source"], r["epoch"], r["tokens"], r["text"]) for r in mixing.mix_sources(spark, make(rows), block=block, weights=weights, slots=slots, slots_a_shard=a_shard, seed=seed).collect()), key=repr)
    keyed = make(rows).filter("text IS NOT NULL").select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text").alias("tie"), F.octet_length("text").alias("n")).collect()
    streams: dict = {}
    for source in weights:
        own = [r for r in keyed if r["source"] == source]
        buckets = max(1, -(-sum(r["n"] for r in own) // size))
        stream = []
        for r in sorted(own, key=lambda r: (r["h"] % buckets, (r["doc_id"] is not None, r["doc_id"] or 0), r["tie"], r["n"])):
            tokens = re.findall(r"[^\t-\r ]+[\t-\r ]*", r["text"])
            if tokens:
                tokens[0] = r["text"][: r["text"].index(tokens[0])] + tokens[0]
            stream.append((r["doc_id"], tokens))
        streams[source] = stream
    names = sorted(n for n in streams if any(t for _, t in streams[n]))
    totals = {n: -(-sum(len(t) for _, t in streams[n]) // block) for n in names}
    share = np.array([weights[n] for n in names]) / sum(weights[n] for n in names)
    shards, taken, expected = -(-slots // a_shard), dict.fromkeys(names, 0), []
    for shard in range(shards):
        n = slots // shards + (shard < slots % shards)
        gen = np.random.Generator(np.random.Philox(key=[seed, shard]))
        counts = gen.multinomial(n, share)
        drawn = [(names[s], j) for s, c in enumerate(counts) for j in range(c)]
        for slot, (source, j) in zip(gen.permutation(n).tolist(), drawn):
            q = taken[source] + j
            epoch = q // totals[source]
            number = int(mixing.permute(np.array([q % totals[source]]), totals[source], mixing.source_key(seed, source, epoch))[0])
            at = 0
            for doc, tokens in streams[source]:
                lo, hi = max(at, number * block), min(at + len(tokens), (number + 1) * block)
                if lo < hi:
                    expected.append((shard, slot, lo - number * block, doc, source, epoch, hi - lo, "".join(tokens[lo - at : hi - at])))
                at += len(tokens)
        for s, c in enumerate(counts):
            taken[names[s]] += int(c)
    assert got == sorted(expected, key=repr)


def test_weights_are_met(spark, make):
    rng = random.Random(2)
    rows = [(i, words(rng, 400), ["big", "big", "big", "big", "mid", None][i % 6]) for i in range(240)]
    shares = {}
    for weights, slots in (({"big": 0.2, "mid": 0.5, "": 0.3}, 3000), (None, None)):
        out = mixing.mix_sources(spark, make(rows), block=32, weights=weights, slots=slots, slots_a_shard=500).select("source", "shard", "slot").distinct().groupBy("source").count().collect()
        total = sum(r["count"] for r in out)
        shares = {r["source"]: r["count"] / total for r in out}
        expected = weights or {k: v / sum(x**0.7 for x in (4, 1, 1)) for k, v in {"big": 4**0.7, "mid": 1, "": 1}.items()}
        assert all(abs(shares[k] - v) < 0.05 for k, v in expected.items())
    same = [rows_of(mixing.mix_sources(spark, make(rows).repartition(n), block=32)) for n in (1, 5)]
    assert same[0] == same[1]
    assert mixing.mix_sources(spark, make([])).count() == 0 and mixing.mix_sources(spark, make([(1, " ", "s"), (2, None, "s")])).count() == 0
    assert mixing.mix_sources(spark, make(rows), weights={"other": 1.0}).count() == 0


def test_pipeline(spark, make, tmp_path):
    """Stage by stage against what each operator says of its own input, and as a whole on planted cases."""
    import corpus_pipeline
    from tesselon.llm import jaccard, sharding

    docs, labels = labelled(600)
    rng = random.Random(77)
    item = words(rng, 40)
    clean = [(5000 + k, words(rng, 250), f"s{k % 4}") for k in range(60)]
    copies = [(6000 + k, clean[k][1] + " more", "s1") for k in range(10)]
    leaks = [(7000 + k, words(rng, 100) + " " + item + " " + words(rng, 100), "s2") for k in range(6)]
    frame = make(docs + clean + copies + leaks).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, words(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        ids.append({r["doc_id"] for r in df.select("doc_id").distinct().collect()})
    good = {5000 + k for k in range(60)}
    assert len(good & ids[0]) >= 57 and len({i for i, q, t in labels if not q or t} & ids[0]) <= 12
    assert not ids[1] & {c[0] for c in copies if c[0] - 1000 in ids[0]} and good & ids[0] == good & ids[1]
    assert not ids[2] & {d[0] for d in leaks} and good & ids[1] == good & ids[2]
    assert ids[3] <= ids[2] and ids[3] == ids[4]
    keys = [r["doc_id"] for r in df.collect()]
    again = sharding.assign_shards(spark.createDataFrame([(i,) for i in set(keys)], "doc_id long"), corpus_pipeline.SHARDS)
    assert {(r["doc_id"], r["shard"]) for r in df.collect()} == {(r["doc_id"], r["shard"]) for r in again.collect()}
    assert jaccard.ngram_jaccard_join(spark, spark.read.parquet(str(tmp_path / "ngram_jaccard_join")), **corpus_pipeline.NEAR).filter("links > 0").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(keys)
    assert SCHEMA.startswith("doc_id")
