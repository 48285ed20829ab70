"""Byte-level BPE against the library, prefix by prefix, through appends and edits."""

import base64
import hashlib
import random

import pytest

pytest.importorskip("facetflow.llm")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from facetflow.llm import prefixes  # noqa: E402

SCHEMA = "doc_id long, text string, ids string, data string, n_tokens long"
AWKWARD = [
    None, "", " \n\t ", "one", "Ünï cödé don't 日本語 <|endoftext|> x  y\n\nz", "a" * 700, "ab" * 400 + "  \t\n  ", "we'll they've I'm 'tis 'l 'll",
    "x" * 70 + "é" * 40, "٣٤٥ 123456789 1e9", "🙂👩‍👩‍👧 " * 30, " 　 a b", "\x00\x01\x7f", "the same " * 5000,
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(prefixes.NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return prefixes.encoder(public_tokenizers.path(prefixes.NAME))


def test_digests_match_the_library(spark, library):
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(AWKWARD)] + [(3, "another text", "x", "y", 0), (None, "no id", "x", "y", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, prefixes.digest(docs).collect()), key=key) == sorted(want, key=key)
    assert prefixes.digest(docs.limit(0)).collect() == []


def test_encode_and_decode_give_the_texts_back(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    encoded = prefixes.encode(docs)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids == {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert {r["doc_id"]: bytes(r["data"]) for r in prefixes.decode(encoded).collect()} == {i: t.encode() for i, t in texts.items()}
    assert prefixes.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect() == [(1, b"")]


def test_every_prefix_has_the_librarys_encoding(own, library):
    rng = random.Random(1)
    for _ in range(60):
        raw = bytes(rng.choice(b"aetnsi oul\xc3\xa9\xa8r") for _ in range(rng.randrange(1, 40)))
        table = own.table(raw)
        for n in range(len(raw), 0, -1):
            table.cut(n)
            assert table.ids() == library._encode_single_piece(raw[:n])


def test_edits_of_a_piece_stay_near(own):
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    raw = "".join(rng.choice(letters) for _ in range(3000))
    table = own.table(raw.encode())
    for _ in range(40):
        start = rng.randrange(len(raw))
        end = min(len(raw), start + rng.randrange(4))
        new = "".join(rng.choice(letters) for _ in range(rng.randrange(4)))
        raw = raw[:start] + new + raw[end:]
        made = table.replace(start, end, new)
        fresh = own.table(raw.encode())
        assert table.raw == raw and table.last == fresh.last and table.open == fresh.open
        assert made <= 400


def test_texts_follow_appends_and_edits(own, library):
    rng = random.Random(3)
    bits = ["the ", "don", "'", "l", "l ", " ", "  ", "\n", "été", "12", "!?", "'s", "日本", "a", "\t"]
    for _ in range(30):
        text = own_text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        kept = prefixes.EncodedText(own, text)
        for _ in range(40):
            new = "".join(rng.choice(bits) for _ in range(rng.randrange(3)))
            if rng.random() < 0.4:
                kept.append(new)
                own_text += new
            else:
                start = rng.randrange(len(own_text) + 1)
                end = min(len(own_text), start + rng.randrange(5))
                kept.replace(start, end, new)
                own_text = own_text[:start] + new + own_text[end:]
            assert kept.text == own_text
            assert kept.ids == library.encode_ordinary(own_text)
            assert own.decode(kept.ids) == own_text.encode()


def test_an_edit_of_a_long_text_cuts_few_pieces(own):
    kept = prefixes.EncodedText(own, "some words and more " * 2000)
    assert kept.replace(20_000, 20_003, "xyz") < 12
    assert kept.append("tail") < 6
