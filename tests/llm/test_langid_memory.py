"""Memory for the score of texts follows a block of codes, not the texts of a batch."""

import tracemalloc

import numpy as np

from facetflow.llm import langid


def scorer():
    grams = np.array([[0, 0, 0, 97], [0, 0, 97, 98], [0, 97, 98, 97], [97, 98, 97, 98]], dtype="<u4")
    tables = [langid.kneser_ney(grams, np.array(n)) for n in ([9, 5, 4, 3], [1, 2, 2, 8])]
    none = np.zeros(2)
    return langid.Scorer(langid.Model(["x", "y"], tables, 2, none, none, none))


def test_many_texts_are_scored_in_bounded_memory():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab c"), 2_000)) for _ in range(900)]
    score = scorer()
    score(texts[:3])  # what a scorer always holds
    tracemalloc.start()
    sums, squares, chars, letters = score(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80_000_000
    k = 700
    one = scorer()([texts[k]])
    assert np.allclose(sums[k], one[0][0], rtol=1e-6) and chars[k] == one[2][0] and letters[k] == one[3][0] == sum(c.isalpha() for c in texts[k])
