"""Pairs of terms by blocks against each pair by itself."""

import random

import numpy as np
import pytest

pytest.importorskip("facetflow.llm")
from facetflow.llm import toxicity  # noqa: E402


def test_pairs_by_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_TERMS", 7)
    monkeypatch.setattr(toxicity, "BLOCK_DOCS", 50)
    rng = random.Random(4)
    rows = []
    for i in range(700):
        own = {t for t in range(20) if rng.random() < 0.03 + 0.02 * t}
        toxic = (3 in own) != (17 in own) if 17 in own else rng.random() < 0.3
        rows.append((i, int(toxic), sorted(own | ({20} if rng.random() < 0.5 else set()))))
    rate = sum(r[1] for r in rows) / len(rows)
    seen = spark.createDataFrame(rows, "doc long, toxic int, terms array<long>").repartition(3)
    n_terms, expected = 20, set()  # the term 20 isn't tried
    limit = 2 * np.log(n_terms * (n_terms - 1) / 2 / toxicity.BY_CHANCE)
    labels = lambda *terms: [y for _, y, own in rows if set(terms) <= set(own)]
    odds = [toxicity.odds((sum(labels(t)) + rate) / (len(labels(t)) + 1)) for t in range(n_terms)]
    for a in range(n_terms):
        for b in range(a):
            y = labels(a, b)
            p = np.clip(1 / (1 + np.exp(-(odds[a] + odds[b] - toxicity.odds(rate)))), 1e-4, 1 - 1e-4)
            if len(y) >= toxicity.PAIR_DOCS:
                k, n = sum(y), len(y)
                d = 2 * ((k * np.log(k / (n * p)) if k else 0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if k < n else 0))
                expected |= {a, b} if d >= limit else set()
    assert toxicity.paired_terms(seen, n_terms, rate) == sorted(expected)
    assert {3, 17} <= expected
    assert toxicity.paired_terms(seen.limit(0), n_terms, rate) == [] and toxicity.paired_terms(seen, 1, rate) == []


def test_a_rare_word_counts_beside_another(spark):
    """A group's name in two documents of a hundred turns an insult's meaning."""
    rng = random.Random(8)
    common = ["abc" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = []
    for i in range(5000):
        insult, group = rng.random() < 0.3, i % 110 == 0 or (i % 37 == 0 and i < 1500)
        toxic = not insult if group else rng.random() < 0.5
        rows.append((i, int(toxic), sorted(rng.sample(range(2, 62), 12)) + [0] * insult + [1] * group))
    texts = [(i, i, " ".join((["insultword", "groupname", *common])[t] for t in own), y) for i, y, own in rows]
    df = spark.createDataFrame(texts, "doc long, doc_id long, text string, toxic int")
    model = toxicity._fitted(df)
    assert {h for h in toxicity.term_hashes("groupname")} & set(model.terms)
