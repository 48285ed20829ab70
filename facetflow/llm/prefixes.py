"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a piece ends with one certain token, so a table of these last tokens, one a
byte, holds the encodings of all prefixes at once.  The next entry follows from those before: of the tokens
that end there it is the one that may stand after the last token of what comes before it.

- Reading the table from its end gives the encoding; cutting it gives that of a shorter prefix.
- Appending bytes adds entries and changes none.
- After an edit the entries before it hold; those after it are made anew only until as many in a row as the
  longest token has bytes are what they were, since nothing further back matters.

Distinct pieces of a block of texts are sorted, and each goes on from the prefix that it shares with the one
before.  A piece that is itself a token is that token, whatever merges would give, as in the library.

Defined results: a null text is an empty one, which has no tokens; rows that repeat a doc_id are encoded each
by itself; special strings are ordinary text; texts of any length are encoded whole; an empty table gives an
empty result; columns other than doc_id and text (or ids), whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from facetflow.llm.bpe import Tokens
from facetflow.llm.common import id_and_text, text_blocks

NAME = "byte_bpe_multi_50k.tiktoken"
PIECE = regex.compile(public_tokenizers.PATTERN)
#: Pieces that a worker remembers at most, and the longest of them; longer ones are encoded whenever they are met.
REMEMBERED, SHORT = 300_000, 64
#: Characters before the end of a text within which a longer text may be cut otherwise: no alternative of the
#: pattern looks further ahead than its longest fixed word and one character more.
LOOKAHEAD = 4
BLOCK = 1_000_000


def vocabulary(path: str) -> tuple[Tokens, list[bytes]]:
    """The tokens of a rank file, bytes as the first 256 characters, and the tokens' bytes by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    by_text = {token.decode("latin-1"): rank for token, rank in ranks.items()}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return Tokens(by_text, lambda left, right: by_text.get(left + right)), by_id


class PrefixTable:
    """The last tokens of all prefixes of some bytes."""

    def __init__(self, tokens: Tokens, openings: set[str], reach: int):
        self.tokens, self.openings, self.reach = tokens, openings, reach
        self.raw = ""
        #: by length of the prefix; the empty one has none
        self.last: list[str] = [""]
        #: starts of what may yet become a token
        self.open: list[int] = []

    def append(self, more: str) -> None:
        n, raw = len(self.raw), self.raw + more
        last, good, openings, follows = self.last, self.tokens.good, self.openings, self.tokens.may_follow
        for i in range(n, len(raw)):
            self.open = [j for j in (*self.open, i) if raw[j : i + 1] in openings]
            for j in self.open:
                token = raw[j : i + 1]
                if token in good and (not j or follows(last[j], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends with byte {ord(raw[i])}")
        self.raw = raw

    def cut(self, n: int) -> None:
        """Only the first n bytes stay."""
        if n < len(self.raw):
            self.raw = self.raw[:n]
            del self.last[n + 1 :]
            self.open = [j for j in range(max(0, n - self.reach), n) if self.raw[j:] in self.openings]

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts new in the place of the bytes from start to end; how many entries were made."""
        rest, before = self.raw[end:], self.last[end + 1 :]
        self.cut(start)
        self.append(new)
        made, same = len(new), 0
        for k, byte in enumerate(rest):
            self.append(byte)
            made += 1
            same = same + 1 if self.last[-1] == before[k] else 0
            if same >= self.reach:
                self.raw += rest[k + 1 :]
                self.last += before[k + 1 :]
                self.open = [j for j in range(max(0, len(self.raw) - self.reach), len(self.raw)) if self.raw[j:] in self.openings]
                break
        return made

    def ids(self) -> list[int]:
        whole = self.tokens.tokens.get(self.raw)
        if whole is not None:
            return [whole]
        out, end = [], len(self.raw)
        while end:
            token = self.last[end]
            out.append(self.tokens.tokens[token])
            end -= len(token)
        return out[::-1]


class Encoder:
    """Encodes and decodes texts; one a worker."""

    def __init__(self, path: str):
        self.tokens, self.by_id = vocabulary(path)
        self.openings = {t[:k] for t in self.tokens.tokens for k in range(1, len(t) + 1)}
        self.reach = max(map(len, self.tokens.tokens))
        self.known: dict[str, tuple[int, ...]] = {}

    def table(self, raw: bytes = b"") -> PrefixTable:
        out = PrefixTable(self.tokens, self.openings, self.reach)
        out.append(raw.decode("latin-1"))
        return out

    def _learn(self, pieces: set[str]) -> None:
        table, before = self.table(), ""
        for raw, piece in sorted((p.encode("utf-8", "surrogatepass").decode("latin-1"), p) for p in pieces):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            table.cut(shared)
            table.append(raw[shared:])
            self.known[piece] = tuple(table.ids())
            before = raw

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        return tuple(self.table(piece.encode("utf-8", "surrogatepass")).ids()) if found is None else found

    def pieces(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """The ids of the pieces of each text."""
        cut = [PIECE.findall(t) for t in texts]
        wanted = {p for own in cut for p in own if len(p) <= SHORT}
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, wanted
        if new:
            self._learn(new)
        return [[self.piece(p) for p in own] for own in cut]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [[i for ids in own for i in ids] for own in self.pieces(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


class EncodedText:
    """A text with its encoding, which follows appends and edits without encoding all of it again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.cuts: list[int] = [0]
        self.ids_of: list[tuple[int, ...]] = []
        self.tail: tuple[str, PrefixTable] | None = None
        self.append(text)

    @property
    def ids(self) -> list[int]:
        return [i for own in self.ids_of for i in own]

    def _piece(self, piece: str, is_last: bool) -> tuple[int, ...]:
        if not is_last:
            return self.encoder.piece(piece)
        # the last piece may be appended to: its table is kept
        before, table = self.tail or ("", self.encoder.table())
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        if not piece.startswith(before):
            table.cut(0)
        table.append(raw[len(table.raw) :])
        self.tail = (piece, table)
        return tuple(table.ids())

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts new in the place of the characters from start to end; how many pieces were cut anew.

        Pieces that end well before the edit stay.  Cutting looks ahead only, so once a new cut falls on an
        old one behind the edit, all further pieces are the old ones.
        """
        first = int(np.searchsorted(self.cuts, start - LOOKAHEAD, side="right")) - 1 if start > LOOKAHEAD else 0
        first = max(first, 0)
        old_cuts, old_ids, shift = self.cuts, self.ids_of, len(new) - (end - start)
        text = self.text = self.text[:start] + new + self.text[end:]
        behind = {c + shift: k for k, c in enumerate(old_cuts) if c >= end}
        self.cuts, self.ids_of = old_cuts[: first + 1], old_ids[:first]
        made, at = 0, self.cuts[-1]
        while at < len(text):
            if made and at in behind and at >= start + len(new):
                k = behind[at]
                self.cuts += [c + shift for c in old_cuts[k + 1 :]]
                self.ids_of += old_ids[k:]
                break
            stop = PIECE.match(text, at).end()
            self.ids_of.append(self._piece(text[at:stop], stop == len(text)))
            self.cuts.append(stop)
            at, made = stop, made + 1
        return made


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, name: str = NAME) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(public_tokenizers.path(name))
        for batch in batches:
            for rows, texts in text_blocks(batch, BLOCK):
                ids = [np.array(x, dtype=np.int32) for x in own(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = NAME) -> DataFrame:
    """doc_id and data (binary: the bytes of the text) of encoded documents; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(public_tokenizers.path(name))
        for batch in batches:
            data = [own.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(docs: DataFrame, name: str = NAME) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (what the ids give back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(public_tokenizers.path(name))
        decimal = list(map(str, range(len(own.by_id))))
        for batch in batches:
            for rows, texts in text_blocks(batch, BLOCK):
                n, encoded, decoded = [], [], []
                for ids in own(texts):
                    n.append(len(ids))
                    encoded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
