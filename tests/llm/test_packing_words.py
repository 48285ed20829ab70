"""The encoder of packing gives the library's ids, asks the library for a word once and remembers only short ones."""

import random

import pytest

pytest.importorskip("facetflow.llm")

from facetflow.llm import packing  # noqa: E402


class Counted:
    """Passes texts on to the vocabulary's library and counts their characters and the words "common"."""

    def __init__(self, fast):
        self.fast, self.chars, self.common = fast, 0, 0

    def encode_ordinary(self, text):
        self.chars += len(text)
        self.common += text.count("common")
        return self.fast.encode_ordinary(text)


@pytest.fixture
def own():
    encoder = packing.Encoder()
    encoder.fast = Counted(encoder.fast)
    return encoder


def test_marks_at_the_ends_of_words_make_no_new_words(own):
    plain, marked = "some words that stand here alone", "some, words. that; stand: here! alone?"
    own([plain, "\n".join(plain.split())])
    own.fast.chars = 0
    own([marked, "\n".join(marked.split())])
    assert own.fast.chars < 20  # before: each of the words with its mark again


def test_words_of_a_block_stay_when_others_go(own, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    for k in range(40):
        own(["a common word " + " ".join(f"rare{k}x{j}" for j in range(20))])
        assert len(own.known) <= 330
    assert own.fast.common == 1  # before: again each time


def test_long_words_are_not_remembered(own):
    own([" ".join(chr(97 + k) * 100_000 for k in range(5)) + " short"])
    assert sum(map(len, own.known)) < 1000  # before: half a million


def test_ids_are_the_librarys(own, monkeypatch):
    rng = random.Random(11)
    bits = ["don't", "I'll", "'s", "'", "''", "a'", "cat's,", "end.", "end..", ".end", "(x)", '"q"', "1995.", "3,5", "10%", "ü.", "naïve,", "日本。", "日本,", "½.", "²,", "_", "_.", "-", "a-b;", "x" * 90, "👩‍👧!", "é", "é,", ",", "!", "?)", "A1.", "٣,", "<", "<|endoftext|", "the", "the,", "'t", "t'", "ll'"]
    texts = ["", " ", "\n", ",", " ,", ".", "a.", "a. ", "a.\n", "\na.", " a", "the ", "the\n", "x  y", "x\n\ny", "a b.", "b.\x1c", "<|endoftext|>", "a <|endoftext|>. b"]
    for _ in range(600):
        texts.append("".join(rng.choice(bits) + rng.choice([" ", " ", " ", "\n", ""]) for _ in range(rng.randrange(1, 25))))
    want = [own.full.encode(t, add_special_tokens=False).ids for t in texts]
    for block, most in ((1 << 20, 200_000), (1, 200_000), (37, 40)):
        monkeypatch.setattr(packing, "BLOCK", block)
        monkeypatch.setattr(packing, "REMEMBERED", most)
        found = own(texts)
        assert [list(memoryview(x).cast("H")) for x in found] == want
        assert own([]) == []
        assert own(["", ""]) == [b"", b""]
