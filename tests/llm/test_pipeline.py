"""The pipeline, stage by stage, against brute force."""


import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from facetflow.llm import packing, secrets  # noqa: E402
from facetflow.llm.queries import oracle_sql, queries  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "substrings", "secrets", "packing"]
    known = stages["language"](spark, docs, sf_dir)
    assert known.columns == columns and known.count() == docs.count()
    one = stages["near_duplicates"](spark, known, sf_dir)
    rows = [r.asDict() for r in one.collect()]
    assert one.columns == columns and len({r["text"] for r in rows}) == len(rows) < docs.count()
    # every text that is gone has a like one that stayed
    shingles = lambda t: set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False))
    kept = [shingles(r["text"]) for r in rows]
    gone = {r["doc_id"]: r["text"] for r in known.collect()}
    for r in rows:
        gone.pop(r["doc_id"])
    for t in gone.values():
        s = shingles(t)
        assert any(len(s & k) >= 0.7 * len(s | k) for k in kept)
    cut = stages["substrings"](spark, one, sf_dir)
    first, words = {}, {r["doc_id"]: r["text"].encode().split() for r in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][k : k + 20]), (i, k))
    for r in cut.collect():
        w = words[r["doc_id"]]
        late = {k + j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (r["doc_id"], k) for j in range(20)}
        assert r["text"].encode().split() == [x for k, x in enumerate(w) if k not in late]
        assert r["n_chars"] == len(r["text"]) or not late
    clean = stages["secrets"](spark, cut, sf_dir)
    assert clean.columns == columns and clean.count() == cut.count()
    assert not any(secrets.base_spans(r["text"]) for r in clean.collect())
    pieces = stages["packing"](spark, clean, sf_dir).collect()
    tokens = {r["doc_id"]: len(packing.encoder().full.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean.collect()}
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == tokens


def test_run_ends_with_pieces(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, expected = queries()[name](spark, sf_dir).toPandas(), db.sql(oracle_sql()[name]).df()
    tidy = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(str).itertuples(index=False, name=None)))
    assert tidy(found) == tidy(expected)
