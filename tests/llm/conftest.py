import random

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key int, part int, shard string, dir string, value double"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}x{rng.randrange(40)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text, source) as documents with further columns whose names the operators use inside."""

    def build(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2, "y", None, 0.5) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated rows, lines in common, characters of all sizes."""
    rng = random.Random(5)
    a, b = words(rng, 300), words(rng, 300)
    block = "\n".join(words(rng, 12) for _ in range(12))
    rows = [
        (1, a, "s0"), (2, a, "s1"), (2, a, "s1"), (3, a[:-3] + " changed", "s0"), (4, "", "s0"), (5, None, "s0"), (6, "", "s2"), (7, "  \n\n ", "s0"), (8, b + "\n" + block, None), (9, block + "\n" + words(rng, 50), "s1"),
        (10, words(rng, 60_000), "s0"), (11, "一二三 四五六 ümlaut 🙂 ä ö", "s1"), (12, "one", "s0"), (13, "same\nsame\nsame\nsame\nsame\nsame", "s0"), (-4, b, ""), (14, "x" * 200_000, "s0"), (15, words(rng, 80), "s2"), (16, "one\r\ntwo three\x00four", "s0"),
    ]
    rows += [(100 + k, words(rng, 40 + 3 * k), f"s{k % 3}") for k in range(20)]
    return rows


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over pandas-free lists of rows given as tables."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, (schema, rows) in tables.items():
            con.execute(f"CREATE TABLE {name} ({schema})")
            if rows:
                con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        result = con.sql(sql)
        columns = list(result.columns)
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)

    return run


def rows_of(df):
    order = sorted(df.columns)
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
