"""Media columns: baseline JPEG.

The decoder parses markers, Huffman-decodes the scans of 8-bit baseline images (grey or colour, any
sampling, restart intervals) and rebuilds the luminance from the DC coefficients alone, a thumbnail
of one pixel a block.  All restart intervals of many images are decoded side by side in numpy.

The writer stores bytes without loss: byte b becomes the quantized coefficient b + 1, 64 to a block,
nine blocks to a restart interval; all quantizers are 1.  As no coefficient is zero, no run and no
end-of-block code occurs.

Defined results: a null or empty text is stored as one padded interval; equal texts give equal rows;
texts beyond MOST_ROWS intervals use wider images, whose surplus blocks follow the payload; no text is cut;
repeated rows give repeated rows; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
BLOCKS = UNIT // 64
MOST_ROWS = 2700  # intervals of three by three blocks below the largest height
#: Payload bytes that are coded side by side.
GROUP_BYTES = 3_000_000

# The order in which a block's coefficients are stored.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

#: Symbols of the writer's tables by code length, commonest first: sizes of DC differences and of AC values.
DC_SYMBOLS = {2: [4, 5], 3: [3, 6], 4: [2, 7], 5: [0, 1], 6: [8], 7: [9]}
AC_SYMBOLS = {1: [7], 2: [6], 3: [8], 4: [5], 5: [4], 6: [3], 7: [2], 8: [1, 9]}


def _codes(symbols: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, bits)."""
    out, code, before = {}, 0, 0
    for bits in sorted(symbols):
        code <<= bits - before
        before = bits
        for s in symbols[bits]:
            out[s] = (code, bits)
            code += 1
    return out


def _table_segment(kind: int, symbols: dict[int, list[int]]) -> bytes:
    body = bytes([kind]) + bytes(len(symbols.get(b, [])) for b in range(1, 17)) + bytes(s for b in sorted(symbols) for s in symbols[b])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _shape(units: int) -> tuple[int, int]:
    """Blocks across and down of an image for so many intervals."""
    wide = -(-units // MOST_ROWS)
    return 3 * wide, 3 * -(-units // wide)


def _coded(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and extra bits of each value as one number, and how many bits it has."""
    size = np.zeros(len(values), dtype=np.int64)
    magnitude = np.abs(values)
    for b in range(11):
        size += magnitude >= 1 << b
    code, bits = np.zeros(16, dtype=np.int64), np.zeros(16, dtype=np.int64)
    for s, (c, n) in codes.items():
        code[s], bits[s] = c, n
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return (code[size] << size) | extra, bits[size] + size


def write_images(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of UNIT."""
    shapes = [_shape(len(p) // UNIT) for p in payloads]
    units = [w * h // BLOCKS for w, h in shapes]
    data = np.frombuffer(b"".join(p + bytes(n * UNIT - len(p)) for p, n in zip(payloads, units, strict=True)), dtype=np.uint8).reshape(-1, BLOCKS, 64)
    levels = data.astype(np.int64) + 1
    n = len(data)
    levels[:, 1:, 0], first = np.diff(levels[:, :, 0], axis=1), levels[:, 0, 0]
    levels[:, 0, 0] = first
    # all values of one kind are few, so codes come from tables of them
    span = np.arange(-256, 257)
    dc, dc_bits = _coded(span, _codes(DC_SYMBOLS))
    ac, ac_bits = _coded(np.arange(1, 257), _codes(AC_SYMBOLS))
    value = ac[np.maximum(levels, 1) - 1].astype(np.uint32)
    bits = ac_bits[np.maximum(levels, 1) - 1].astype(np.uint8)
    value[:, :, 0], bits[:, :, 0] = dc[levels[:, :, 0] + 256], dc_bits[levels[:, :, 0] + 256]
    value, bits = value.reshape(n, UNIT), bits.reshape(n, UNIT)
    # places of the codes: each interval begins at a byte and is filled up with ones
    ends = np.cumsum(bits, axis=1, dtype=np.int64)
    used = ends[:, -1]
    sizes = (used + 7) // 8
    at = np.concatenate([[0], np.cumsum(sizes)])
    position = ends - bits + (at[:-1] * 8)[:, None]
    # a code of up to 17 bits lies in four bytes; sums of disjoint bits are their union
    word = value.ravel().astype(np.uint64) << (np.uint64(32) - (position.ravel() & 7).astype(np.uint64) - bits.ravel())
    byte = position.ravel() >> 3
    out = np.zeros(at[-1] + 4, dtype=np.float64)
    for k in range(4):
        out += np.bincount(byte + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=len(out))
    raw = out[:-4].astype(np.uint8)
    raw[at[1:] - 1] |= ((1 << (sizes * 8 - used)) - 1).astype(np.uint8)
    images, k = [], 0
    for (w, h), own in zip(shapes, units, strict=True):
        parts = [raw[at[i] : at[i + 1]].tobytes().replace(b"\xff", b"\xff\x00") for i in range(k, k + own)]
        scan = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < own else b"") for i, p in enumerate(parts))
        images.append(_header(w, h) + scan + b"\xff\xd9")
        k += own
    return images


def _header(w: int, h: int) -> bytes:
    return (
        b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
        + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8 * h, 8 * w, 1) + bytes([1, 0x11, 0])
        + _table_segment(0x00, DC_SYMBOLS) + _table_segment(0x10, AC_SYMBOLS)
        + b"\xff\xdd" + struct.pack(">HH", 4, BLOCKS) + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
    )


@dataclass
class Image:
    """What the markers of a baseline image say."""

    width: int = 0
    height: int = 0
    components: list[dict] = field(default_factory=list)
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    intervals: list[bytes] = field(default_factory=list)


def parse(media: bytes) -> Image:
    """Reads the markers of a baseline JPEG with one scan; raises ValueError for any other."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start-of-image marker")
    image, at = Image(), 2
    while True:
        while media[at : at + 1] == b"\xff" and media[at + 1 : at + 2] == b"\xff":
            at += 1
        if media[at : at + 1] != b"\xff" or at + 4 > len(media):
            raise ValueError("a marker was expected")
        kind, (length,) = media[at + 1], struct.unpack(">H", media[at + 2 : at + 4])
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantizers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC0 or kind == 0xC1:
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("8-bit samples only")
            image.components = [{"id": c[0], "h": c[1] >> 4, "v": c[1] & 15, "q": c[2]} for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xDD:
            (image.restart,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            if body[0] != len(image.components):
                raise ValueError("one interleaved scan is expected")
            for i in range(body[0]):
                for c in image.components:
                    if c["id"] == body[1 + 2 * i]:
                        c["dc"], c["ac"] = body[2 + 2 * i] >> 4, 16 | (body[2 + 2 * i] & 15)
            break
    end = len(media)
    start = at
    find = at
    while (find := media.find(b"\xff", find)) >= 0 and find + 1 < len(media):
        mark = media[find + 1]
        if 0xD0 <= mark <= 0xD7:
            image.intervals.append(media[start:find].replace(b"\xff\x00", b"\xff"))
            start = find + 2
        elif mark not in (0, 0xFF):
            end = find
            break
        find += 2 if mark != 0xFF else 1
    image.intervals.append(media[start:end].replace(b"\xff\x00", b"\xff"))
    return image


def _decoding_table(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    table, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for bits in range(1, 17):
        for _ in range(lengths[bits - 1]):
            table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _blocks(image: Image) -> list[tuple[int, int]]:
    """The blocks of one MCU: (component, number within it)."""
    if len(image.components) == 1:
        return [(0, 0)]
    return [(i, b) for i, c in enumerate(image.components) for b in range(c["h"] * c["v"])]


def _mcus(image: Image) -> tuple[int, int]:
    if len(image.components) == 1:
        return -(-image.width // 8), -(-image.height // 8)
    return -(-image.width // (8 * max(c["h"] for c in image.components))), -(-image.height // (8 * max(c["v"] for c in image.components)))


def decode(images: list[Image]) -> list[np.ndarray]:
    """Quantized coefficients of images that share tables and layout: an array (MCU, block, 64) in stored
    order for each, DC differences undone.  Intervals of all images advance together, a symbol a step."""
    model = images[0]
    layout = _blocks(model)
    tables = {k: _decoding_table(*t) for k, t in model.tables.items()}
    counts, parts = [], []
    for image in images:
        total = int(np.prod(_mcus(image)))
        step = image.restart or total
        counts += [min(step, total - step * i) for i in range(-(-total // step))]
        if len(image.intervals) < -(-total // step):
            raise ValueError("restart intervals are missing")
        parts += image.intervals[: -(-total // step)]
    n, most = len(parts), max(counts)
    counts_ = np.array(counts)
    at = np.concatenate([[0], np.cumsum([len(p) + 8 for p in parts])])
    raw = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts) + bytes(8), dtype=np.uint8)
    ahead = np.zeros(len(raw) - 7, dtype=np.uint64)
    for k in range(8):
        ahead = (ahead << np.uint64(8)) | raw[k : k + len(ahead)]
    limit = at[1:] * 8 - 8
    position = at[:-1] * 8
    out = np.zeros((most, len(layout), 64, n), dtype=np.int16)
    last = np.zeros((len(model.components), n), dtype=np.int64)

    def take(who: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol and the value of its extra bits."""
        p = position[who]
        window = ahead[p >> 3] << (p & 7).astype(np.uint64)
        entry = table[(window >> np.uint64(48)).astype(np.int64)]
        if (entry == 0).any():
            raise ValueError("a code that no table has")
        bits, symbol = entry >> 8, entry & 255
        size = symbol & 15
        v = ((window << bits.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
        position[who] = np.minimum(p + bits + size, limit[who])
        return symbol, v

    everyone = np.arange(n)
    for m in range(most):
        running = everyone if m < counts_.min() else np.flatnonzero(counts_ > m)
        for b, (c, _) in enumerate(layout):
            spec = model.components[c]
            _, v = take(running, tables[spec["dc"]])
            last[c, running] += v
            out[m, b, 0, running] = last[c, running]
            k = np.ones(len(running), dtype=np.int64)
            who = running
            while len(who):
                symbol, v = take(who, tables[spec["ac"]])
                run, size = symbol >> 4, symbol & 15
                k = k + np.where(size == 0, np.where(run == 15, 16, 64), run)
                here = (size > 0) & (k < 64)
                if here.all() and (k[0] == k).all():
                    if len(who) == n:
                        out[m, b, k[0]] = v
                    else:
                        out[m, b, k[0], who] = v
                else:
                    out[m, b, k[here], who[here]] = v[here]
                k = k + (size > 0)
                if (k >= 64).any():
                    more = k < 64
                    who, k = who[more], k[more]
    # gather each image's intervals again
    results, i = [], 0
    for image in images:
        total = int(np.prod(_mcus(image)))
        own = -(-total // (image.restart or total))
        part = np.moveaxis(out[:, :, :, i : i + own], 3, 0)
        results.append(part.reshape(-1, len(layout), 64)[:total] if own == 1 or (image.restart and total % image.restart == 0) else np.concatenate([part[j, : counts[i + j]] for j in range(own)]))
        i += own
    return results


def decode_all(images: list[Image]) -> list[np.ndarray]:
    """decode(), grouped by tables and layout, which must agree among images that advance together."""
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        layout = tuple((c["h"], c["v"], c["dc"], c["ac"]) for c in image.components)
        groups.setdefault((layout, tuple(sorted(image.tables.items()))), []).append(i)
    out: list[np.ndarray] = [np.zeros(0)] * len(images)
    for own in groups.values():
        for i, x in zip(own, decode([images[i] for i in own]), strict=True):
            out[i] = x
    return out


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC coefficient: mean sample value, 0 to 255."""
    c = image.components[0]
    across, down = _mcus(image)
    h, v = (1, 1) if len(image.components) == 1 else (c["h"], c["v"])
    dc = coefficients[:, : h * v, 0].astype(np.int64) * image.quantizers[c["q"]][0]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip(np.floor(grid / 8 + 128 + 0.5), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 by 8 areas of the thumbnail are brighter than their mean."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    edges = [(np.arange(9) * n) // 8 for n in pixels.shape]
    low = [e[:-1] for e in edges]
    high = [np.maximum(e[1:], e[:-1] + 1) for e in edges]
    area = sums[np.ix_(high[0], high[1])] - sums[np.ix_(low[0], high[1])] - sums[np.ix_(high[0], low[1])] + sums[np.ix_(low[0], low[1])]
    mean = area / ((high[0] - low[0])[:, None] * (high[1] - low[1])[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that write_images() stored (with surplus blocks, if any)."""
    return (coefficients[:, 0, :] - 1).astype(np.uint8).tobytes()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored image of every whole text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _grouped(batch, "raw", _write_rows)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    return raw.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _grouped(batch: pa.RecordBatch, column: str, make) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    column_ = batch.column(column)
    for i in range(len(column_)):
        n = len(column_[i].as_buffer())
        if i > start and size + n > GROUP_BYTES:
            yield make(batch.slice(start, i - start))
            start, size = i, 0
        size += n
    if len(column_) > start:
        yield make(batch.slice(start))


def _write_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = batch.column("raw").to_pylist()
    padded = [r + b"\xff" * (-len(r) % UNIT if r else UNIT) for r in raw]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(write_images(padded), pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURE_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def read_features(media: DataFrame) -> DataFrame:
    """Decodes the stored images: digests of the bytes they hold, dimensions and thumbnail hashes."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored, n_bytes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
        images = [parse(m) for m in stored]
        out = []
        for m, n, image, x in zip(stored, n_bytes, images, decode_all(images), strict=True):
            size = n + -n % UNIT if n else UNIT
            payload = payload_of(x)[:size]
            small = thumbnail(image, x)
            feature = f"{image.width}x{image.height}:{small.shape[1]}x{small.shape[0]}:{thumbnail_hash(small)}:{zlib.crc32(small.tobytes()):08x}"
            out.append((n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, image.width, image.height))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[c.split()[0] for c in FEATURE_COLUMNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _grouped(batch, "media", rows)

    return media.mapInArrow(run, FEATURE_COLUMNS)
