"""Token counts by finite-state transducers.

Two transducers are compiled from a tokenizer's file.

1. The splitter reads classes of characters.  Its transitions carry the number of words that begin.  A
   text block is cut into chunks of equal length; every chunk is run from all states at once, which
   gives its state map, and the maps are composed by a parallel prefix scan, which gives the state
   that each chunk really starts in.
2. The word transducer reads the symbols of a word.  Its transitions carry the change in the number of
   tokens of what has been read.  A state holds what can still matter: the longest ending of the word
   so far that begins some token, with the last tokens and counts of the prefixes within it; so there are
   finitely many, made when first met.

Each different word of a block runs through the second transducer once.

Counts are those of the library for word_bpe_49k.json without added tokens: text is composed (NFC) and
lower-cased, white space dropped; special strings within a text are one token each.  Null counts as
empty: 0 tokens.  Equal texts, repeated rows too, get equal counts; texts of any length are counted whole; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from facetflow.llm.bpe import WORD_END, ForwardStates, Tokens
from facetflow.llm.common import id_and_text, text_blocks

LIMIT = 2048
CHUNK = 256
REMEMBERED = 400_000
MOST_STATES = 200_000

# Classes of characters: blanks, other letters, numbers, signs, apostrophe; letters of 's 't 'm 'd, 're, 've, 'll.
BLANK, LETTER, NUMBER, SIGN, QUOTE, ONE, R, V, L, E, RESET = range(11)
# States: between words, within letters, within signs, after an opening quote, and after its r, v or l.
GAP, IN_LETTERS, IN_SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: Outputs: a word begins here; a word began at the character before.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs, by state and class, of the splitting pattern."""
    letters = (LETTER, ONE, R, V, L, E)
    following, output = np.zeros((7, 11), dtype=np.uint8), np.zeros((7, 11), dtype=np.uint8)
    for state in range(7):
        for c in range(11):
            if c in letters:
                go, out = IN_LETTERS, 0 if state == IN_LETTERS else HERE
            elif c == NUMBER:
                go, out = GAP, HERE
            elif c == SIGN or c == QUOTE:
                go, out = IN_SIGNS, 0 if state in (IN_SIGNS, QUOTED) else HERE
                if c == QUOTE and out:
                    go = QUOTED
            else:
                go, out = GAP, 0
            if state == QUOTED and c == ONE:
                go, out = GAP, 0
            elif state == QUOTED and c in (R, V, L):
                go, out = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            elif (state, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
                go, out = GAP, 0
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):
                # no contraction after all: its letter opened a word
                out |= BEFORE
                if c in letters:
                    out = BEFORE
            following[state, c], output[state, c] = go, out
    return following, output


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point.  Code point 10 stands between texts; line feeds become blanks before."""
    if not _CLASSES:
        every = "".join(map(chr, range(0x110000)))
        table = np.full(0x110000, SIGN, dtype=np.uint8)
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = c
        for text, c in (("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E), ("\n", RESET)):
            for x in text:
                table[ord(x)] = c
        _CLASSES.append(table)
    return _CLASSES[0]


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """maps[i] after maps[i - 1] ... after maps[0], for all i, in a logarithmic number of steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
        step *= 2
    return out


def run_splitter(classes: np.ndarray, following: np.ndarray, output: np.ndarray) -> np.ndarray:
    """The outputs for all characters, from state GAP on."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, RESET, dtype=np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    states, kinds = following.shape
    flat, out_flat = following.ravel(), output.ravel()
    now = np.repeat(np.arange(states, dtype=np.uint8)[:, None], chunks, axis=1)
    for row in steps:
        now = flat[now * np.uint8(kinds) + row]
    ends = prefix_scan(np.ascontiguousarray(now.T))
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = ends[:-1, GAP]
    outputs = np.empty((CHUNK, chunks), dtype=np.uint8)
    for k, row in enumerate(steps):
        at = state * np.uint8(kinds) + row
        outputs[k] = out_flat[at]
        state = flat[at]
    return np.ascontiguousarray(outputs.T).ravel()[:n]


class WordTransducer(ForwardStates):
    """Token counts of words: transitions carry changes of the count, final ones those of the last symbol."""

    def __init__(self, vocabulary: Tokens):
        super().__init__(vocabulary, counted=True, most=MOST_STATES)

    def count(self, word: str) -> int:
        if len(self.states) > self.most:
            self.clear()
        state, total, steps = 0, 0, self.steps
        for symbol in word[:-1]:
            state, _, change = steps[state].get(symbol) or self.step(state, symbol)
            total += change
        final = self.ends[state].get(word[-1])
        if final is None:
            final = self.ends[state][word[-1]] = self.last(state, word[-1] + WORD_END)[2]
        return total + final


def byte_letters() -> dict[str, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the rest from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Tokens:
    """The vocabulary with word ends of a .json file; tokens as strings of one character a byte."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, letters = model["end_of_word_suffix"], str.maketrans(byte_letters())

    def own(text: str) -> str:
        return text[: -len(suffix)].translate(letters) + WORD_END if text.endswith(suffix) else text.translate(letters)

    ranks = {(own(a), own(b)): i for i, (a, b) in enumerate(model["merges"])}
    return Tokens({own(t): i for t, i in model["vocab"].items() if t not in SPECIAL}, lambda a, b: ranks.get((a, b)))


SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = regex.compile("|".join(map(regex.escape, SPECIAL)))


class Counter:
    """Token counts of whole texts."""

    def __init__(self, name: str = "word_bpe_49k"):
        import public_tokenizers

        self.transducer = WordTransducer(read_vocabulary(public_tokenizers.path(f"{name}.json")))
        self.following, self.output = splitter()
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.transducer.count(word.decode("latin-1"))
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts, owner = [], []
        extra = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if "<|" in text and (pieces := _SPECIAL.split(text)) and len(pieces) > 1:
                extra[i] = len(pieces) - 1
            else:
                pieces = [text]
            for piece in pieces:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                parts.append(piece.lower().replace("\n", " "))
                owner.append(i)
        joined = "\n".join(parts)
        raw = joined.encode("utf-8", "surrogatepass")
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            return extra
        classes = _classes()[points]
        outputs = run_splitter(classes, self.following, self.output)
        begins = (outputs & HERE) > 0
        begins[:-1] |= (outputs[1:] & BEFORE) > 0
        blank = (classes == BLANK) | (classes == RESET)
        cut = begins.copy()
        cut[1:] |= blank[1:] & ~blank[:-1]
        cut[0] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(width)
        at = np.flatnonzero(cut)
        offsets = np.append(ends[at] - width[at], len(raw))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        number = pieces.indices.to_numpy(zero_copy_only=False)
        word = begins[at]
        used = np.zeros(len(pieces.dictionary), dtype=bool)
        used[number[word]] = True
        counts = np.zeros(len(used), dtype=np.int64)
        counts[used] = [self._word(w) for w in pieces.dictionary.filter(pa.array(used)).to_pylist()]
        # texts begin after the feeds between them
        part = np.cumsum(points == 10)[at]
        totals = np.bincount(part[word], weights=counts[number[word]], minlength=len(parts)).astype(np.int64)
        np.add.at(extra, np.asarray(owner), totals)
        return extra


_COUNTERS: dict[str, Counter] = {}


def counter(name: str = "word_bpe_49k") -> Counter:
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, limit: int = LIMIT, name: str = "word_bpe_49k") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            for rows, texts in text_blocks(batch, 1_000_000):
                n = count(texts)
                sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
