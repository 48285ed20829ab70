"""Packing along a space-filling curve.

Every document becomes a vector of hashed token counts, projected to DIMS dimensions; its Hilbert key
orders the documents, so that neighbours on the curve are alike.  Ranges of the curve go to partitions,
which lay their tokens end to end and cut them into sequences.  A partition's last, short stretch is cut
at powers of two, which need no padding, so nothing is padded and no partition waits for another.

Defined results: a null or empty text is the end token alone; equal rows are packed one after the other,
each with its own tokens; ties on the curve go by doc_id, then by the tokens; texts of any length are packed
whole, over as many sequences as they need; an empty table gives no pieces; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm.common import byte_blocks, id_and_text, members, mix64, ranges, shuffle_width, stored

SEQUENCE = 1024
END = 0
DIMS, BITS = 4, 8
FEATURES = 512
#: Words whose ids a Python worker remembers at most, and bytes of each.
REMEMBERED, SHORT = 200_000, 64
#: Characters that are cut into words at once, and bytes of texts that are encoded together.
BLOCK = 1 << 20
#: Tokens for which there is one range of the curve at least.
PARTITION_TOKENS = 24_000_000
SPECIAL = "<|endoftext|>"
#: White space that the fast way of encoding does not cut at: runs of blanks and feeds, and every other kind.
UNEVEN = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
UNEVEN_ASCII = [gap for gap in UNEVEN if gap.isascii()]
#: Marks that are pieces of their own between one of the plain characters and white space or a text's end.
_MARKS, _PLAIN = members(rb"[.,;:!?)\"']"), members(rb"[0-9A-Za-z]")


class Encoder:
    """Ids of whole texts as little-endian 16-bit integers, the same as the vocabulary's own library gives.

    Where white space is single blanks and line feeds only, the split pattern ends a piece before each of
    them, after each line feed, and between a letter or digit and a single mark at a word's end.  So texts are
    cut into words with the blank before them, line feeds and marks; each different one of a block is looked
    up once, and remembered.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = public_tokenizers.path(f"{name}.json")
        self.feed = ranks[b"\n"]
        #: what can't be told apart between line feeds
        self.gaps = {gap: self._ids(gap.decode()) for gap in (b" ", b"\n")}
        self.known = dict(self.gaps)

    @cached_property
    def full(self):
        """The library itself; only texts that hold the special string need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), dtype="<u2").tobytes()

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; what is remembered starts anew from these words when it gets too much."""
        found = list(map(self.known.get, words))
        new = [i for i, own in enumerate(found) if own is None]
        if not new:
            return found
        raw = self._ids(b"\n".join([words[i] for i in new]).decode())
        ends = (np.flatnonzero(np.frombuffer(raw, dtype="<u2") == self.feed) * 2).tolist()
        for i, start, end in zip(new, [0, *[e + 2 for e in ends]], [*ends, len(raw)], strict=True):
            found[i] = raw[start:end]
        again = new
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(self.gaps)
            again = range(min(len(words), REMEMBERED))
        self.known.update((words[i], found[i]) for i in again if len(words[i]) <= SHORT)
        return found

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, or of parts that begin with a blank, whose white space is even."""
        raws = [text.encode() for text in texts]
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)))])
        gaps = np.flatnonzero((data == 32) | (data == 10))
        last = np.concatenate([gaps, borders[1:]]) - 1
        last = last[last > 0]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[borders] = cut[gaps] = True
        cut[gaps[data[gaps] == 10] + 1] = True
        cut[last[_MARKS[data[last]] & _PLAIN[data[last - 1]]]] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        if len(at) < 2:
            return [b""] * len(texts)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        _, offsets, raw = words.dictionary.buffers()
        raw = raw.to_pybytes()
        found = self._look_up([raw[a:b] for a, b in itertools.pairwise(np.frombuffer(offsets, dtype=np.int64)[: len(words.dictionary) + 1].tolist())])
        index = words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        lengths = sizes[index]
        ids = np.frombuffer(b"".join(found), dtype="<u2")[ranges((np.cumsum(sizes) - sizes)[index], lengths)].tobytes()
        ends = (np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(at, borders)] * 2).tolist()
        return [ids[a:b] for a, b in itertools.pairwise(ends)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owners: list[int] = []
        parts: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, own in zip(owners, self._block(parts), strict=True):
                out[i].append(own)
            owners.clear()
            parts.clear()
            size = 0

        for i, text in enumerate(texts):
            if SPECIAL in text:
                out[i].append(np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes())
            elif any(map(text.__contains__, UNEVEN_ASCII if text.isascii() else UNEVEN)):
                out[i].append(self._ids(text))
            else:
                for part in _parts(text):
                    owners.append(i)
                    parts.append(part)
                    size += len(part)
                    if size >= BLOCK:
                        flush()
        flush()
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters that begin with a blank."""
    start = 0
    while len(text) - start > BLOCK and (end := text.find(" ", start + BLOCK)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:] if start else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def projection(seed: int = 7) -> np.ndarray:
    """A fixed random projection of the hashed counts, from hashes, so the same everywhere."""
    bits = mix64(np.arange(FEATURES * DIMS * 12, dtype=np.uint64) + np.uint64(seed << 32))
    uniform = (bits >> np.uint64(11)).astype(float) / (1 << 53)
    return (uniform.reshape(FEATURES, DIMS, 12).sum(axis=2) - 6).astype(np.float64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows), by undoing the rotations bit by bit."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def _buckets() -> np.ndarray:
    """The hashed feature of each 16-bit id."""
    return (mix64(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(50)).astype(np.int64) % FEATURES


def vectors(ids: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed, damped token counts, projected; rows of zeros for texts without tokens."""
    owner = np.repeat(np.arange(len(ids)), [len(own) for own in ids])
    flat = np.concatenate([*ids, np.zeros(0, dtype=np.uint16)])
    counts = np.sqrt(np.bincount(owner * FEATURES + _buckets()[flat], minlength=len(ids) * FEATURES)).reshape(len(ids), FEATURES)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return (counts / np.where(norm > 0, norm, 1)) @ basis


def cells_of(points: np.ndarray) -> np.ndarray:
    """A grid over the projections of unit vectors with positive entries; outliers go to the border."""
    return np.clip(np.floor((points + 2.0) / 4.0 * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)


def tokenize(docs: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, curve key, number of tokens and ids (little-endian 16 bits, with the end token) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, basis = encoder(name), projection()
        end = np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, _, texts in byte_blocks(batch, BLOCK):
                found = encode([t.decode() for t in texts])
                for k in range(0, len(found), 256):
                    ids = found[k : k + 256]
                    key = hilbert_keys(cells_of(vectors([np.frombuffer(x, dtype="<u2") for x in ids], basis)))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(first + k, len(ids)), pa.array(key, pa.int64()), pa.array([len(x) // 2 + 1 for x in ids], pa.int64()), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "curve_key", "n", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, curve_key long, n long, ids binary")


def _lengths(total: int) -> list[int]:
    """Sequence lengths for a partition's tokens: full ones, then the powers of two that make up the rest."""
    full, rest = divmod(total, SEQUENCE)
    return [SEQUENCE] * full + [1 << b for b in range(SEQUENCE.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(tokens: DataFrame, spark: SparkSession) -> DataFrame:
    """Pieces of documents in sequences, from a stored table of tokenize()."""
    n = max(shuffle_width(spark), -(-(tokens.agg(F.sum("n")).first()[0] or 0) // PARTITION_TOKENS))
    # the encoded text breaks ties between rows of one doc_id, so the order is total
    ranged = tokens.repartitionByRange(n, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "ids").withColumn("part", F.spark_partition_id())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = None
        open_docs: list[tuple[int, int, int, np.ndarray]] = []  # doc, start, tokens, ids that wait for a full sequence
        waiting = 0

        def cut(length: int) -> list[tuple]:
            nonlocal sequence, waiting
            rows, filled = [], 0
            while filled < length:
                doc, start, whole, ids = open_docs.pop(0)
                take = min(len(ids), length - filled)
                rows.append((doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), whole, sequence, filled))
                if take < len(ids):
                    open_docs.insert(0, (doc, start + take, whole, ids[take:]))
                filled += take
            waiting -= length
            sequence += 1
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, part, raw in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if sequence is None:
                    sequence = part << 40
                ids = np.frombuffer(raw, dtype="<u2")
                open_docs.append((doc, 0, len(ids), ids))
                waiting += len(ids)
                while waiting >= SEQUENCE:
                    rows += cut(SEQUENCE)
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        rest = [row for length in _lengths(waiting) for row in cut(length)]
        if rest:
            yield batch_of(rest)

    return ranged.select("doc_id", "part", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def pack_documents(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The tokens are stored once: range bounds are sampled from them, and nothing is encoded twice."""
    return pack(stored(tokenize(docs), spark, "packing"), spark)
