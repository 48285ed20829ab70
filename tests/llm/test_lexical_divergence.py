"""Ranked search and source divergence against their SQL, on awkward rows and with small blocks."""

import random

import duckdb
import pytest

pytest.importorskip("facetflow.llm")

from facetflow.llm import divergence, lexical  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, m long, chunk string, n long, slot long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    common = "alpha Beta beta, gamma-delta gamma Été été été. x1 x2 日本 (alpha) 'alpha' don't -- 42".split()
    out = [(i, " ".join(rng.choice(common) + rng.choice(["", "", "!", str(rng.randrange(9))]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(260)]
    out += [(300, None, "en", "a"), (301, "", "en", "d"), (302, " \t\n", "fr", "z"), (303, "-- 4 !", "fr", None), (304, "alpha " * 5000, "en", "b"), out[5], out[5], (7, "another text of id seven alpha", "de", "a"), (305, "a b　c", "en", "a")]
    return [(*r, 1, "x", 2, 3) for r in out]


def compare(df, sql, rows, items=()):
    import pandas as pd

    db = duckdb.connect()
    db.register("documents", pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]))
    db.register("benchmark", pd.DataFrame(list(items), columns=["item_id", "text"]))
    want = db.sql(sql)
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())
    return df.count()


def test_divergence(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 4)  # several blocks of terms
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert compare(divergence.audit(docs, spark), divergence.SQL, rows) > 30
    assert divergence.audit(docs.limit(0), spark).collect() == []


@pytest.mark.parametrize("terms", [100_000, 1])
def test_search(spark, rows, monkeypatch, terms):
    for name, value in (("PARTITION_BYTES", 3000), ("BLOCK_TERMS", terms)):  # what the driver decides by
        monkeypatch.setattr(lexical, name, value)
    if terms == 1:
        monkeypatch.setattr(lexical, "ITEM_TERMS", 0)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = [(1, "ALPHA été"), (2, None), (3, "nowhere"), (4, ""), (5, "don't 日本 x1"), (5, "gamma 42"), (6, "alpha " * 50)]
    if terms == 1:
        items = items[4:]
    found = lexical.search(lexical.build_index(docs, spark), spark.createDataFrame(items, "item_id long, text string"), spark)
    assert compare(found, lexical.SQL, rows, items) >= 20
    if terms > 1:
        assert lexical.search(lexical.build_index(docs.limit(0), spark), spark.createDataFrame(items, "item_id long, text string"), spark).collect() == []
        assert lexical.search(lexical.build_index(docs, spark), spark.createDataFrame([], "item_id long, text string"), spark).collect() == []
