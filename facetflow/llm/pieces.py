"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The different marked words of a block are sorted, which lays them out as a trie in depth-first order:
each word shares a prefix with the word before it, and the forward values of that prefix are reused.

The available model is a byte-pair model: scores only order its merges, and the path with the best sum
of scores isn't what the library gives.  So the forward value of a prefix is the last piece of its
encoding, and an arc is admissible if its piece may follow the last piece of where it starts (see bpe);
exactly one arrives at each position.  The backward pass over the chosen arcs gives the pieces.

White space is kept: blanks become marks, one is put before a text; no piece goes from another character
to a mark, so texts are cut there.  Characters without a piece become the pieces of their bytes.
A null or empty text has no pieces.  Decoding turns pieces back into the text, without the mark put
before; a text that holds the mark itself (U+2581) comes back with blanks in its place.  Equal texts, repeated
rows too, get equal pieces; ties between merges go to the left one, as in the library; texts of any length are
encoded whole; an empty table gives an empty result; columns other than doc_id and text (ids) are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetflow.llm.bpe import ForwardStates, Tokens
from facetflow.llm.common import id_and_text, text_blocks

MARK = "▁"
REMEMBERED = 400_000
MOST_STATES = 300_000
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Ids of texts as little-endian 16-bit integers."""

    def __init__(self, name: str = "piece_bpe_32k"):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.bytes_ = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.is_byte = {i: b for b, i in self.bytes_.items()}
        #: what a piece stands for, where that doesn't depend on others: all but bytes beyond ASCII
        self.plain = ["" if special[i] else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        for b, i in self.bytes_.items():
            self.plain[i] = chr(b) if b < 128 else ""
        self.beyond = np.zeros(n, dtype=bool)
        self.beyond[[i for b, i in self.bytes_.items() if b >= 128]] = True
        self.hidden = {i for i in range(n) if special[i]} - set(self.is_byte)
        scores = {p: model.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}

        def rank(a: str, b: str) -> float | None:
            score = scores.get(a + b)
            return None if score is None else -score

        self.vocabulary = Tokens({p: i for i, p in enumerate(self.pieces) if not special[i]}, rank)
        self.forward = ForwardStates(self.vocabulary, counted=False, most=MOST_STATES)
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked:
            return WORD.findall(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def learn(self, words: list[str]) -> None:
        """Encodes sorted, different words, the forward values of shared prefixes once."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        if len(self.forward.states) > MOST_STATES:
            self.forward.clear()
        tokens, steps, step = self.vocabulary.tokens, self.forward.steps, self.forward.step
        before = ""
        # of each prefix of the word: the forward state and the last piece
        states, last = [0], [""]
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[-1]
            for symbol in word[shared:]:
                state, piece, _ = steps[state].get(symbol) or step(state, symbol)
                states.append(state)
                last.append(piece)
            before = word
            path, end = [], len(word)
            while end:
                path.append(last[end])
                end -= len(path[-1])
            ids: list[int] = []
            for piece in reversed(path):
                if piece in tokens:
                    ids.append(tokens[piece])
                else:
                    ids += [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")]
            self.known[word] = np.array(ids, dtype="<u2").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        wanted = {w for own in cut for w in own}
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, wanted
        if new:
            self.learn(sorted(new))
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        if not self.beyond[ids].any():
            return "".join(map(self.plain.__getitem__, ids.tolist())).removeprefix(" ")
        out = bytearray()
        for i in ids.tolist():
            if i in self.is_byte:
                out.append(self.is_byte[i])
            elif i not in self.hidden:
                out += self.pieces[i].encode()
        return out.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "piece_bpe_32k") -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encode(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_blocks(batch):
                ids = [np.frombuffer(x, dtype="<u2").astype(np.int32) for x in encoder(name)(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(name).decode(np.asarray(x.as_py(), dtype=np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of 32-bit little-endian ids), decoded_sha256 and whether decoding gave the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_blocks(batch):
                own = encoder(name)
                out = []
                for text, raw in zip(texts, own(texts), strict=True):
                    ids = np.frombuffer(raw, dtype="<u2")
                    back = own.decode(ids)
                    out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
                n, crc, sha, same = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")
