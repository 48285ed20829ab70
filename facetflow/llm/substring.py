"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of a document.  The minimiser of a window is the least hash of its
runs of SEED words, so equal windows have equal minimisers.  Consecutive windows that share a minimiser
travel together as one packed string to the minimiser's bucket; there, sorting brings equal windows
together, and every window but the earliest is a repeat.  A word is removed if a repeat covers it.

- A task first settles what it can: a window that also starts earlier within the task's block is a
  repeat at once and does not travel.
- Minimisers with a large share of all strings would make hot buckets (a passage that very many documents
  share, the same words within many different surroundings).  They are found beforehand, from counts over
  all documents, and settled in two steps: first their buckets are cut by block, and every part settles its
  own windows; then the earliest of each travel on, window by window, to buckets of their own hashes.  So
  what meets in one place is at most one string of a window for each part.
- A hash only brings candidates together: windows count as equal if all their words are equal.

Defined results: the order is by doc_id, then start.  Rows that repeat a doc_id with the same text are one
document: neither is earlier.  Rows that repeat a doc_id with different texts have one place in the order, by
start, but each loses only words of its own: what is found for them is told apart by a key of the text, which is
0 for all other rows, so that it costs them nothing.  Rows without a doc_id have no place in the order: they stay whole and make
nothing a repeat.  Null and empty texts have no words; texts with fewer than WINDOW words stay whole; texts
of any length are cut whole; an empty table gives an empty result.  Columns other than doc_id and text,
whatever their names, are ignored by find() and digest(), and passed through by clean().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm.common import id_and_text, mix64, shuffle_width, span_hashes, stored, unused, words_of

WINDOW = 20
SEED = 4
BLOCK_BYTES = 2_000_000
#: Buckets for each shuffle partition, and bytes of text for which there is one partition at least.
BUCKETS_EACH = 12
PARTITION_BYTES = 48_000_000
#: Packed rows that a task copies from a batch at once.
ROWS = 256
#: Minimisers that may be told apart as hot: what isn't hot makes less than one part in so many of all strings.
MOST_HOT = 100_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Words:
    """The words of several byte strings (words separated by one blank), without windows across strings."""

    def __init__(self, strings: list[bytes]):
        self.raw = b"\n".join(strings)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.starts, self.ends = words_of(self.data)
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        #: the first word of each string, and each word's string
        self.first = np.searchsorted(self.starts, offsets)
        counts = np.diff(self.first)
        self.string = np.repeat(np.arange(len(strings)), counts)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        n = len(self.starts)
        #: starts of windows that lie within one string
        at = np.arange(max(n - WINDOW + 1, 0))
        self.windows = at[self.string[at] == self.string[at + WINDOW - 1]] if n >= WINDOW else at

    def minimisers(self) -> np.ndarray:
        """For each word that a window can start at, the least hash of the runs of SEED words in it."""
        n = len(self.starts)
        if n < WINDOW:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n - SEED + 1)
        least = span_hashes(self.hashes, at, at + SEED)
        wide, wanted = 1, WINDOW - SEED + 1
        while wide * 2 <= wanted:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        return np.minimum(least[: n - WINDOW + 1], least[wanted - wide : wanted - wide + n - WINDOW + 1])

    def window_hashes(self) -> np.ndarray:
        return span_hashes(self.hashes, self.windows, self.windows + WINDOW)

    def exact_ids(self) -> np.ndarray:
        """A number for each word, equal just for equal words."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, dtype=np.int64)
        # words and the single bytes between them, in turn
        cuts = np.empty(2 * n, dtype=np.int64)
        cuts[0::2], cuts[1::2] = self.starts, self.ends
        offsets = np.append(cuts, len(self.data))
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.raw)])
        return both.dictionary_encode().indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)


def repeats(words: Words, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of words.windows also start earlier; doc and start place each of them."""
    n = len(words.windows)
    late = np.zeros(n, dtype=bool)
    if n < 2:
        return late
    hashes = words.window_hashes()
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return late
    # only windows that share a hash go on
    touched = np.zeros(n, dtype=bool)
    touched[1:] |= same
    touched[:-1] |= same
    some = order[touched]
    some = some[np.lexsort((start[some], doc[some], hashes[some]))]
    lead = np.ones(len(some), dtype=bool)
    lead[1:] = hashes[some[1:]] != hashes[some[:-1]]
    first = some[np.maximum.accumulate(np.where(lead, np.arange(len(some)), 0))]
    ids = words.exact_ids()
    a, b = words.windows[some], words.windows[first]
    equal = np.ones(len(some), dtype=bool)
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    late[some] = equal & ((doc[some] > doc[first]) | (start[some] > start[first]))
    for h in np.unique(hashes[some[~equal]]):  # different windows under one hash: settled one by one
        seen: dict[bytes, tuple[int, int]] = {}
        for i in some[hashes[some] == h]:
            text = ids[words.windows[i] : words.windows[i] + WINDOW].tobytes()
            place = (int(doc[i]), int(start[i]))
            late[i] = seen.setdefault(text, place) < place
    return late


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Doc ids, keys and normalized texts, in the order of the ids, about BLOCK_BYTES at a time."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    keys = batch.column("key").to_numpy(zero_copy_only=False) if "key" in batch.schema.names else np.zeros_like(ids)
    texts = batch.column("text").cast(pa.binary())
    order = np.argsort(ids, kind="stable")
    start, size, strings = 0, 0, []
    for k, i in enumerate(order):
        own = b" ".join(texts[int(i)].as_py().split())
        strings.append(own)
        size += len(own) + 1
        if size >= BLOCK_BYTES or k + 1 == len(order):
            yield ids[order[start : k + 1]], keys[order[start : k + 1]], strings
            start, size, strings = k + 1, 0, []


def _merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Each document's repeats as intervals of words [from, to), in 64-bit pairs."""
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    apart = other.copy()
    apart[1:] |= start[1:] > start[:-1] + 1
    low = np.flatnonzero(apart)
    high = np.append(low[1:], len(doc)) - 1
    pairs = np.column_stack([start[low], start[high] + WINDOW]).astype("<i8")
    cuts = np.flatnonzero(other[low])
    for a, b in zip(cuts, np.append(cuts[1:], len(low)), strict=True):
        yield int(doc[low[a]]), int(key[low[a]]), pairs[a:b].tobytes()


def hot_minimisers(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Minimisers with more than a share 1 / parts of all packed strings, parts = min(4 buckets, MOST_HOT), and
    the number of shuffle partitions for texts of this size (width at least).

    At most parts of them exist.  A block reports those above half that share of its own strings: one that
    is above the share in all is so in some block.
    """
    parts = min(4 * BUCKETS_EACH * width, MOST_HOT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, strings in _blocks(batch):
                words = Words(strings)
                least = words.minimisers()[words.windows]
                lead = np.append(True, (least[1:] != least[:-1]) | (np.diff(words.windows) != 1)) if len(least) else np.zeros(0, dtype=bool)
                values, n = np.unique(least[lead], return_counts=True)
                most = n >= max(2, int(lead.sum()) / (2 * parts))
                # the row of the null key counts strings and bytes
                keys = pa.array([*values[most].view(np.int64).tolist(), None], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([*n[most].tolist(), int(lead.sum())], pa.int64()), pa.array([*[0] * int(most.sum()), len(words.raw)], pa.int64())], names=["least", "n", "size"])

    sums = docs.mapInArrow(count, "least long, n long, size long").groupBy("least").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    top = sums.orderBy(F.col("least").isNotNull(), F.desc("n")).limit(parts + 1).collect()
    if not top:
        return np.zeros(0, dtype=np.uint64), width
    total, size = top[0]["n"], top[0]["size"]
    hot = np.sort(np.array([r["least"] for r in top[1:] if r["n"] >= max(8, total / parts)], dtype=np.int64).view(np.uint64))
    return hot, max(width, -(-size // PARTITION_BYTES))


def _blob(words: Words, low: np.ndarray, high: np.ndarray, places: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Strings of words low[i] .. high[i] (inclusive) with their places, compressed."""
    a, b = words.starts[low].tolist(), words.ends[high].tolist()
    strings = b"\n".join([words.raw[x:y] for x, y in zip(a, b, strict=True)])
    return squeeze.compress(_head(places) + strings)


def _head(places: np.ndarray) -> bytes:
    """The number of strings and their places (doc, key, start); keys are left out where all are 0, and the number
    is negative where they aren't."""
    keyed = places[:, 1].any()
    some = places if keyed else places[:, [0, 2]]
    return np.array([-len(places) if keyed else len(places)], dtype="<i8").tobytes() + some.astype("<i8").tobytes()


def super_kmers(docs: DataFrame, buckets: int, hot: np.ndarray, parts: int) -> DataFrame:
    """(bucket, part, doc_id, key, data): packed strings of a bucket, compressed (doc_id null), or what a block
    settled.  Strings of hot minimisers are dealt over parts by block; part is null for all others."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for ids, keys, strings in _blocks(batch):
                words = Words(strings)
                at = words.windows
                if not len(at):
                    continue
                doc, key = ids[words.string[at]], keys[words.string[at]]
                start = at - words.first[words.string[at]]
                late = repeats(words, doc, start)
                out: list[tuple] = [(d % buckets, None, d, k, x) for d, k, x in _merged(doc[late], key[late], start[late])]
                keep = ~late
                at, least = at[keep], words.minimisers()[at[keep]]
                places = np.column_stack([doc[keep], key[keep], start[keep]])
                lead = np.ones(len(at), dtype=bool)
                lead[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1])
                low = np.flatnonzero(lead)
                if len(low):
                    high = np.append(low[1:], len(at)) - 1
                    bucket = (mix64(least[low]) % np.uint64(buckets)).astype(np.int64) * 2 + np.isin(least[low], hot)
                    order = np.argsort(bucket, kind="stable")
                    low, high, bucket = low[order], high[order], bucket[order]
                    part = int(mix64(np.array([ids[0]], dtype=np.int64).view(np.uint64))[0] % np.uint64(parts))
                    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                    for i, j in zip(cuts, [*cuts[1:], len(low)], strict=True):
                        own, is_hot = divmod(int(bucket[i]), 2)
                        out.append((own, part if is_hot else None, None, None, _blob(words, at[low[i:j]], at[high[i:j]] + WINDOW - 1, places[low[i:j]], squeeze)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _PACKED_TYPES, strict=True)], names=_PACKED_NAMES)

    return docs.mapInArrow(pack, PACKED)


PACKED = "bucket long, part int, doc_id long, key long, data binary"
_PACKED_NAMES, _PACKED_TYPES = ["bucket", "part", "doc_id", "key", "data"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _opened(blobs: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of a bucket, and the place (doc, key, start) of each of their windows."""
    all_places, strings = [], []
    open_ = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = open_.decompress(blob)
        n = int(np.frombuffer(raw[:8], dtype="<i8")[0])
        wide = 2 if n > 0 else 3
        end = 8 + 8 * wide * abs(n)
        places = np.zeros((abs(n), 3), dtype=np.int64)
        places[:, [0, 2] if wide == 2 else [0, 1, 2]] = np.frombuffer(raw[8:end], dtype="<i8").reshape(-1, wide)
        all_places.append(places)
        strings += raw[end:].split(b"\n")
    words = Words(strings)
    own = words.string[words.windows]
    doc, key, start = np.concatenate(all_places)[own].T
    return words, doc, key, start + words.windows - words.first[own]


class _Firsts:
    """Windows that wait to be packed, one by one, for the buckets of their own hashes."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.strings: list[bytes] = []
        self.rows: list[np.ndarray] = []

    def add(self, words: Words, late: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> None:
        bucket = (mix64(words.window_hashes()[~late]) % np.uint64(self.buckets)).astype(np.int64)
        at = words.windows[~late]
        a, b = words.starts[at].tolist(), words.ends[at + WINDOW - 1].tolist()
        self.strings += [words.raw[x:y] for x, y in zip(a, b, strict=True)]
        self.rows.append(np.column_stack([bucket, doc[~late], key[~late], start[~late]]))

    def packed(self, squeeze: zstandard.ZstdCompressor) -> Iterator[tuple[int, bytes]]:
        if not self.strings:
            return
        rows = np.concatenate(self.rows)
        order = np.argsort(rows[:, 0], kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(rows[order, 0]) != 0)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[i:j]
            strings = b"\n".join([self.strings[k] for k in own.tolist()])
            yield int(rows[own[0], 0]), squeeze.compress(_head(rows[own, 1:]) + strings)
        self.strings, self.rows = [], []


def _pooled(rows: list[tuple]) -> list[tuple]:
    """Rows of one document as one: their spans one after the other."""
    spans: dict[tuple[int, int], list] = {}
    out = []
    for row in rows:
        if row[2] is None:
            out.append(row)
        else:
            spans.setdefault(row[2:4], [row[0]]).append(row[4])
    return out + [(bucket, None, *place, b"".join(parts)) for place, (bucket, *parts) in spans.items()]


def _settled(packed: DataFrame, width: int, buckets: int, last: bool) -> DataFrame:
    """packed with its buckets settled: rows with a doc_id pass through.  Unless this is the last step, what has a
    part is settled within it, and its earliest windows become rows of their own buckets, without a part."""
    keys = ["bucket"] if last else ["bucket", "part"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, out = None, [], []
        squeeze, firsts = zstandard.ZstdCompressor(level=3), _Firsts(buckets)

        def finish() -> None:
            if not blobs:
                return
            words, doc, key, start = _opened(blobs)
            blobs.clear()
            late = repeats(words, doc, start)
            out.extend((current[0], None, d, k, x) for d, k, x in _merged(doc[late], key[late], start[late]))
            if current[1] is not None and not last:
                firsts.add(words, late, doc, key, start)

        def batch_of() -> pa.RecordBatch:
            rows = _pooled(out) + [(b, None, None, None, x) for b, x in firsts.packed(squeeze)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PACKED_TYPES, strict=True)], names=_PACKED_NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for bucket, part, doc_id, key, data in zip(*(rows.column(c).to_pylist() for c in _PACKED_NAMES), strict=True):
                    if doc_id is not None:
                        out.append((bucket, None, doc_id, key, data))
                        continue
                    if (bucket, part) != current:
                        finish()
                        current = (bucket, part)
                    blobs.append(data)
                if len(out) > 50_000 or len(firsts.strings) > 50_000:
                    yield batch_of()
        finish()
        yield batch_of()

    return packed.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(settle, PACKED)


@dataclass
class Found:
    """Intervals of words that repeats cover (doc_id, key, spans: 64-bit pairs; some rows for a document), and the
    ids that stand for different texts (None: no id does)."""

    spans: DataFrame
    shared: DataFrame | None


def _shared_ids(docs: DataFrame, spark: SparkSession) -> DataFrame | None:
    """(doc_id) of rows with one id and different texts; hashes are counted, not texts."""
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    shared = stored(texts.where("a <> b").select("doc_id"), spark, "shared-ids")
    return None if shared.isEmpty() else shared


def _keyed(docs: DataFrame, shared: DataFrame | None, name: str) -> DataFrame:
    """docs with a key of the text where other rows have the same id, else 0."""
    if shared is None:
        return docs.withColumn(name, F.lit(0).cast("long"))
    own, mark = unused(docs, "shared_doc", "shared_mark")
    marks = shared.select(F.col("doc_id").alias(own), F.lit(True).alias(mark))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(marks, docs["doc_id"].cast("long") == F.col(own), "left").withColumn(name, F.when(F.col(mark), F.xxhash64(text)).otherwise(F.lit(0))).drop(own, mark)


def find(docs: DataFrame, spark: SparkSession) -> Found:
    """What repeats cover in each document."""
    docs = id_and_text(docs).where(F.col("doc_id").isNotNull())
    shared = _shared_ids(docs, spark)
    docs = _keyed(docs, shared, "key")
    hot, width = hot_minimisers(docs, shuffle_width(spark))
    buckets = BUCKETS_EACH * width
    settled = _settled(super_kmers(docs, buckets, hot, width), width, width, not len(hot))
    if len(hot):
        # stored, so that spans found so far needn't travel with the few windows that are settled again
        settled = stored(settled, spark, "spans")
        again = _settled(settled.where("doc_id is null"), width, width, True)
        settled = settled.where("doc_id is not null").union(again)
    return Found(settled.select("doc_id", "key", F.col("data").alias("spans")), shared)


def _with_spans(docs: DataFrame, found: Found) -> tuple[DataFrame, str]:
    """docs with their spans, and that column's name; a document's spans are bounded by its length."""
    doc, key, own, mine = unused(docs, "span_doc", "span_key", "spans", "text_key")
    spans = found.spans.groupBy(F.col("doc_id").alias(doc), F.col("key").alias(key)).agg(F.collect_list("spans").alias(own))
    keyed = _keyed(docs, found.shared, mine)
    return keyed.join(spans, (keyed["doc_id"].cast("long") == F.col(doc)) & (keyed[mine] == F.col(key)), "left").drop(doc, key, mine), own


def _removed(n: int, spans: list[bytes] | None) -> np.ndarray:
    gone = np.zeros(n, dtype=bool)
    for a, b in np.frombuffer(b"".join(spans or []), dtype="<i8").reshape(-1, 2):
        gone[a:b] = True
    return gone


def digest(docs: DataFrame, found: Found) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by single blanks."""

    rows, own = _with_spans(id_and_text(docs), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = []
            for i, spans in enumerate(batch.column(own).to_pylist()):
                words = texts[i].as_py().split()
                n = len(words)
                if spans:
                    gone = _removed(n, spans)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            a, b, c = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, found: Found) -> DataFrame:
    """docs, all columns, with the repeated words cut out of the texts; other white space stays.

    n_chars, where docs has it, follows the text.  Documents of which nothing is left are dropped.
    """
    schema = docs.schema
    rows, own = _with_spans(docs, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            spans, texts = batch.column(own).to_pylist(), batch.column(k).to_pylist()
            changed = [i for i, s in enumerate(spans) if s]
            keep = np.ones(len(texts), dtype=bool)
            for i in changed:
                raw = texts[i].encode()
                at = [m.span() for m in WORD.finditer(raw)]
                gone = _removed(len(at), spans[i])
                parts, cut = [], 0
                for j in np.flatnonzero(gone):
                    parts.append(raw[cut : at[j][0]])
                    cut = at[j + 1][0] if j + 1 < len(at) else len(raw)
                texts[i] = b"".join([*parts, raw[cut:]]).decode().rstrip() if not gone.all() else ""
                keep[i] = not gone.all()
            batch = batch.drop_columns([own])
            if changed:
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
                c = batch.schema.get_field_index("n_chars")
                if c >= 0:
                    chars = batch.column(c).to_pylist()
                    for i in changed:
                        chars[i] = len(texts[i])
                    batch = batch.set_column(c, batch.schema.field(c), pa.array(chars, batch.schema.field(c).type))
                batch = batch.filter(pa.array(keep))
            yield batch

    return rows.mapInArrow(run, schema)


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS s FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM r, range(0, 20) AS t(o) WHERE n > 1),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS s, count(*) AS n
         FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
