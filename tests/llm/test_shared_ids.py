"""Rows that share a doc_id but not a text, through substring dedup and the whole pipeline."""

import random

import pytest

pytest.importorskip("facetflow.llm")

from facetflow.llm import substring  # noqa: E402

SCHEMA = "doc_id long, text string"


def plain(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


@pytest.mark.parametrize("hot", [False, True])
def test_only_words_of_the_own_text_go(spark, monkeypatch, hot):
    rng = random.Random(6)
    p, q, r = plain(rng, 25), plain(rng, 40), plain(rng, 30)
    rows = [(1, p), (5, p), (5, q), (5, f"{r} {p}"), (7, q), (7, q), (8, None), (8, ""), (8, r), (None, p)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if hot:
        import numpy as np

        every = np.unique(substring.Words([t.encode() for t in (p, q, r, f"{r} {p}")]).minimisers())
        monkeypatch.setattr(substring, "hot_minimisers", lambda d, n: (every, 3))
    left = sorted((row["doc_id"] or 0, row["text"]) for row in substring.clean(df, substring.find(df, spark)).collect() if row["text"])
    # of id 5 the text q and the words r before p are first; of id 8 the text r comes later
    assert left == sorted([(1, p), (5, q), (5, r), (0, p)])
    counts = sorted((row["doc_id"] or 0, row["n_words"], row["n_removed"]) for row in substring.digest(df, substring.find(df, spark)).collect())
    assert counts == sorted([(1, 25, 0), (5, 25, 25), (5, 40, 0), (5, 55, 25), (7, 40, 40), (7, 40, 40), (8, 0, 0), (8, 0, 0), (8, 30, 30), (0, 25, 0)])


def test_the_pipeline_keeps_what_is_new(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in real.where("lang = 'en'").limit(30).collect()]
    long = max(rows, key=lambda r: len(r["text"] or ""))
    other = next(r for r in rows if r["doc_id"] != long["doc_id"] and len(r["text"]) > 300)
    extra = [
        {**long, "text": other["text"] + " and something new"}, {**long, "text": None}, {**long, "doc_id": None}, {**other, "text": ""},
        {**long, "doc_id": 10_001, "text": " ".join([long["text"]] * 20)}, {**other, "source": None, "lang": None, "n_chars": None},
    ]
    clashing = {"spans": "a", "key": "b", "text_key": "c", "score": 1.0, "ids": "d"}
    docs = spark.createDataFrame([{**r, **clashing} for r in rows + extra], real.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", spans string, key string, text_key string, score double, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and all(p["length"] > 0 for p in pieces)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
