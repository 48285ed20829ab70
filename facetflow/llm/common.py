"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import tables

#: Characters that a task turns into numpy arrays at once.
BLOCK_CHARS = 2_000_000
#: Values whose spans are hashed together.
SPAN_VALUES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, keep_null: bool = False) -> DataFrame:
    """Only the two columns that the operators read, whatever else the table has."""
    text = F.col("text") if keep_null else F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_hash_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: the fixed held-out split."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def stored(df: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    return tables.stored(df, label)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_blocks(batch: pa.RecordBatch, limit: int = BLOCK_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of rows whose texts have about limit characters together; (row numbers, texts)."""
    rows: list[int] = []
    texts: list[str] = []
    size = 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        text = text or ""
        if rows and size + len(text) > limit:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(text)
        size += len(text)
    if rows:
        yield rows, texts


def byte_blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch whose texts have about limit bytes together: from, to, texts."""
    texts = batch.column("text").cast(pa.binary())
    if not len(texts):
        return
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
        yield a, b, texts[a:b].to_pylist()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of unsigned 64-bit integers (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ in UTF-8 bytes."""
    solid = np.empty(len(data) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=solid[1:-1].view(bool))
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                step = np.uint64(pow(base, len(p), 1 << 64))
                p = np.concatenate([p, p * step])
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


_BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans values[start:end], from prefix sums (any equal spans agree).

    A hash doesn't depend on where its span lies, so spans in order are hashed in turns of about SPAN_VALUES
    values: memory besides the result follows that and the longest span, not the number of values."""
    if len(values) <= SPAN_VALUES:
        return _near_hashes(values, starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out[order] = span_hashes(values, starts[order], ends[order])
        return out
    if (ends[1:] < ends[:-1]).any():
        return _near_hashes(values, starts, ends)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + SPAN_VALUES, "right")))
        out[a:b] = _near_hashes(values[low : int(ends[b - 1])], starts[a:b] - low, ends[a:b] - low)
        a = b
    return out


def _near_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(values)
    power, inverse = _powers(n + 1)
    mixed = _BYTES[values] if values.dtype == np.uint8 else mix64(values)
    mixed *= power[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed, out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= inverse[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return mix64(h)


def members(pattern: bytes) -> np.ndarray:
    """For each byte, whether it matches a class of single bytes, such as rb"[0-9]"."""
    found = re.compile(pattern, re.DOTALL)
    return np.array([found.match(bytes([b])) is not None for b in range(256)])


def runs_of(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are members."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = member[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of some spans that don't touch, in order, equal just for equal spans; the spans by number."""
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    # spans and what lies between them, in turn
    cuts = np.empty(2 * n + 1, dtype=np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(raw)
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)])
    encoded = both.dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False)[0::2]
    used = np.zeros(len(encoded.dictionary), dtype=bool)
    used[index] = True
    return (np.cumsum(used) - 1)[index], encoded.dictionary.filter(pa.array(used))


def joined(strings: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The strings with a line feed after each but the last, and where each begins (one more than there are)."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    return b"\n".join(strings), np.concatenate([[0], np.cumsum(sizes + 1)])


def packed(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each of the lengths (in elements of data, one after the other)."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * data.dtype.itemsize
    if offsets[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of binary values, and how many each of them has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype=dtype), np.diff(offsets) // size


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the starts, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
