"""Every query of the catalogue against its SQL, at the smallest scale, and with one partition or several."""

import math
import os

import duckdb
import pytest

from tesselon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = {c: i for i, c in enumerate(result.columns)}
    expected = sorted(str([plain(r[order[c]]) for c in df.columns]) for r in result.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.collect()) == expected


def test_partitions_do_not_matter(spark):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, catalogue.QUERIES["provenance_union"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
