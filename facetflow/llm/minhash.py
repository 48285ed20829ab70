"""MinHash near-dedup with improved consistent weighted sampling (ICWS).

A document is a weighted set of shingles of five words (ASCII letters lower-cased); a shingle weighs its
count times the mean inverse document frequency of its words.  Frequencies are counted over all documents
in a fixed number of hashed cells, so the table that every task gets has a fixed size.

ICWS draws, for each of BANDS * ROWS hashes, the shingle with the least a = ln c - r (t - b + 1), where
t = floor(ln w / r + b) and r, c, b are fixed random values of the shingle; shingle and t together are
the sample.  Documents that agree in all ROWS samples of a band are candidates.

- Equal texts are collapsed first: what is linked are different texts, not documents.
- In each band's bucket, all members are compared with the bucket's first.  Those that are not like it are
  then compared with every member by their samples alone, a block of either at a time; only texts of pairs
  that agree in half of the samples (a pair with similarity 0.8 fails that about once in a million) travel
  and are verified, likeliest first, unless links found before join them.  So a bucket misses only links
  between texts of one component, and gives no more links than it has members.
- A pair links if the weighted Jaccard similarity of its texts is at least SIMILARITY.

Defined results: null texts and texts without words link with nothing, not even with each other, and so do
rows without a doc_id; all of these are kept.  Texts of fewer than five words are one shingle.  Rows that
share a doc_id but not the text are different documents.  Of rows with equal doc_id and text, keep_one()
keeps one.  An empty table gives an empty result; texts of any length are compared whole.  Columns other
than doc_id and text, whatever their names, are ignored by near_duplicates(), passed through by keep_one().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.llm.common import id_and_text, mix64, shuffle_width, span_hashes, stored, unused, words_of
from facetflow.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
HASHES = BANDS * ROWS
CELLS = 1 << 16
DRAWS = 1 << 15
BLOCK_BYTES = 2_000_000
#: Members of a bucket, and bytes of their texts, that are one block: a task meets two blocks.
BUCKET_BLOCK, BUCKET_BYTES = 1_500, 16_000_000
#: Members that are compared with one copy of their bucket's first text.
HEAD_BLOCK = 1_000
#: A word character; words are what lies between blanks and control characters 9 to 13.
HAS_WORD = r"[^\x20\x09-\x0D]"


def _normalized(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """First row and normalized texts of about BLOCK_BYTES at a time."""
    texts = batch.column("text").cast(pa.binary())
    start, size, strings = 0, 0, []
    for i in range(len(texts)):
        strings.append(_normalized(texts[i].as_py()))
        size += len(strings[-1]) + 1
        if size >= BLOCK_BYTES or i + 1 == len(texts):
            yield start, strings
            start, size, strings = i + 1, 0, []


def _words(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each string (and one beyond)."""
    data = np.frombuffer(b"\n".join(strings), dtype=np.uint8)
    starts, ends = words_of(data)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    return span_hashes(data, starts, ends), np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the word)) + 1, by hashed cell, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            for _, strings in _blocks(batch):
                hashes, first = _words(strings)
                doc = np.repeat(np.arange(len(strings)), np.diff(first))
                pairs = np.unique(doc * CELLS + _cells(hashes))
                total += np.bincount(pairs % CELLS, minlength=CELLS)
                n += len(strings)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["cell", "n"])

    counts = docs.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(CELLS)
    own = counts[counts["cell"] >= 0]
    table[own["cell"].to_numpy(dtype=int)] = own["n"].to_numpy()
    n = counts.loc[counts["cell"] < 0, "n"].sum()
    return np.log((1 + n) / (1 + table)) + 1


def weighted_sets(strings: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and weights, sorted within each string, and each string's first entry (and one beyond)."""
    hashes, first = _words(strings)
    n = len(hashes)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(strings)), counts)
    weight = np.concatenate([[0.0], np.cumsum(idf[_cells(hashes)])])
    at = np.arange(max(n - SHINGLE + 1, 0))
    at = at[doc[at] == doc[at + SHINGLE - 1]] if len(at) else at
    ends = at + SHINGLE
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    at, ends = np.concatenate([at, first[short]]), np.concatenate([ends, first[short + 1]])
    key = span_hashes(hashes, at, ends)
    mean = (weight[ends] - weight[at]) / np.maximum(ends - at, 1)
    owner = doc[at] if len(at) else at
    # sums over many words leave rounding errors behind, which equal shingles must not show
    mean = np.round(mean, 6).astype(np.float32)
    order = np.lexsort((key, owner))
    key, owner, mean = key[order], owner[order], mean[order]
    lead = np.ones(len(key), dtype=bool)
    lead[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    low = np.flatnonzero(lead)
    times = np.diff(np.append(low, len(key)))
    return key[low], mean[low] * times.astype(np.float32), np.searchsorted(owner[low], np.arange(len(strings) + 1))


_DRAWN: list[tuple] = []


def _draws() -> tuple[np.ndarray, ...]:
    """Fixed random values: r and ln c (of Gamma(2, 1) variables), b uniform; a row for each hash."""
    if not _DRAWN:
        shape = (HASHES, DRAWS)
        r, inverse, log_c, b = (np.empty(shape, dtype=np.float32) for _ in range(4))
        for k in range(HASHES):  # one hash at a time, as a task's memory is small
            at = (np.arange(5, dtype=np.uint64)[:, None] * np.uint64(HASHES) + np.uint64(k)) * np.uint64(DRAWS) + np.arange(DRAWS, dtype=np.uint64)
            u = np.maximum((mix64(at + np.uint64(1)) >> np.uint64(11)).astype(float) / (1 << 53), 1e-12)
            own = -np.log(u[0] * u[1])
            r[k], inverse[k], log_c[k], b[k] = own, 1 / own, np.log(-np.log(u[2] * u[3])), u[4]
        multipliers = mix64(np.arange(HASHES, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        _DRAWN.append((r, inverse, log_c, b, multipliers))
    return _DRAWN[0]


def samples(keys: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The HASHES samples (32-bit) of each string with shingles, from weighted_sets()."""
    r, inverse, log_c, b, multipliers = _draws()
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(some), HASHES), dtype=np.uint32)
    if not len(some):
        return out
    log_w = np.log(np.maximum(weights, np.float32(1e-6)))
    short = (keys >> np.uint64(16)).astype(np.uint32)
    for k in range(HASHES):
        at = (keys * multipliers[k] >> np.uint64(64 - 15)).astype(np.int64)
        b_, r_ = b[k][at], r[k][at]
        t = np.floor(log_w * inverse[k][at] + b_)
        a = log_c[k][at] - r_ * (t - b_ + np.float32(1))
        # shifted above zero, the bits of a float sort as it does
        bits = np.maximum(a + np.float32(1024), np.float32(0)).view(np.uint32).astype(np.uint64)
        sample = short ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[:, k] = np.minimum.reduceat(bits << np.uint64(32) | sample, first[some]).astype(np.uint32)
    return out


def sketch(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """A row for each of docs: doc_id, digests of the text and of the normalized text, samples, band keys and
    bytes; without words all but doc_id and raw are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for start, strings in _blocks(batch):
                keys, weights, first = weighted_sets(strings, idf)
                drawn = samples(keys, weights, first)
                some = np.flatnonzero(np.diff(first) > 0)
                at = np.arange(0, HASHES, ROWS)
                bands = mix64(span_hashes(drawn.ravel(), (np.arange(len(some))[:, None] * HASHES + at).ravel(), (np.arange(len(some))[:, None] * HASHES + at + ROWS).ravel()) + np.tile(np.arange(BANDS, dtype=np.uint64), len(some)))
                n = len(strings)
                digests, rows = [None] * n, [None] * n
                for k, i in enumerate(some.tolist()):
                    digests[i], rows[i] = hashlib.md5(strings[i], usedforsecurity=False).digest(), drawn[k].tobytes()
                raw = [hashlib.md5(texts[start + i].as_py(), usedforsecurity=False).digest() for i in range(n)]
                has = np.zeros(n, dtype=bool)
                has[some] = True
                cuts = np.append(0, np.cumsum(np.where(has, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands.view(np.int64)))
                sizes = pa.array([len(x) for x in strings], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, n), pa.array(raw, pa.binary()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), lists, sizes], names=["doc_id", "raw", "digest", "samples", "bands", "size"])

    return docs.mapInArrow(run, "doc_id long, raw binary, digest binary, samples binary, bands array<long>, size long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least))


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, head, similarity) of the pairs (node, head, parts) that are alike, from their whole texts.

    A head has as many copies of its text as it has parts, so that its members meet in many tasks.
    """
    copies = pairs.groupBy("head").agg(F.max("parts").alias("parts"))
    heads = texts.select(F.col("node").alias("head"), F.col("text").alias("text_b")).hint("merge").join(copies, "head").select("head", "text_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("node", "head", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}

        def set_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            key = hashlib.md5(text, usedforsecurity=False).digest()
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = weighted_sets([_normalized(text)], idf)[:2]
            return known[key]

        for batch in batches:
            left, right = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            found = [similarity(set_of(left[i].as_py()), set_of(right[i].as_py())) for i in range(len(left))]
            keep = np.flatnonzero(np.array(found, dtype=float) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep)), batch.column("head").take(pa.array(keep)), pa.array(np.array(found, dtype=float)[keep])], names=["node", "head", "similarity"])

    a = texts.select("node", F.col("text").alias("text_a"))
    joined = salted.join(a.hint("merge"), "node").join(heads.hint("merge"), ["head", "salt"]).select("node", "head", "text_a", "text_b")
    return joined.mapInArrow(run, "node long, head long, similarity double")


class _Block:
    """Members of a bucket that wait in a task, by their samples."""

    def __init__(self, number: int):
        self.number = number
        self.nodes: list[int] = []
        self.rows: list[np.ndarray] = []
        self.matrix: np.ndarray | None = None

    def hold(self, node: int, row: np.ndarray) -> None:
        self.nodes.append(node)
        self.rows.append(row)

    def near(self, node: int, row: np.ndarray) -> np.ndarray:
        """Waiting members that agree in half of the samples, likeliest first.  A pair that shares several
        bands is met in the first."""
        if self.matrix is None:
            self.matrix = np.stack(self.rows) if self.rows else np.zeros((0, HASHES), dtype=np.uint32)
            self.known = np.array(self.nodes, dtype=np.int64)
        same = self.matrix == row
        agree = same.sum(axis=1)
        found = np.flatnonzero((agree * 2 >= HASHES) & (self.known != node))
        shared = same[found].reshape(len(found), BANDS, ROWS).all(axis=2)
        found = found[shared.argmax(axis=1) == self.number]
        return found[np.argsort(-agree[found], kind="stable")]


class _Bucket(_Block):
    """The same with texts, and the components that links among them have formed so far."""

    def __init__(self, number: int, idf: np.ndarray):
        super().__init__(number)
        self.idf = idf
        self.texts: list[bytes] = []
        self.sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _set(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        if h not in self.sets:
            self.sets[h] = weighted_sets([_normalized(self.texts[h])], self.idf)[:2]
        return self.sets[h]

    def meet(self, node: int, text: bytes, row: np.ndarray) -> list[tuple[int, int]]:
        """Links of a member to waiting ones, one for each component that it joins."""
        near = self.near(node, row)
        if not hasattr(self, "label"):
            self.place = {d: h for h, d in enumerate(self.nodes)}
            self.label = np.arange(len(self.nodes))
        own = self.place.get(node)
        label = -1 if own is None else self.label[own]
        found, mine = [], None
        while True:
            near = near[self.label[near] != label]
            if not len(near):
                return found
            h, near = near[0], near[1:]
            if mine is None:
                mine = weighted_sets([_normalized(text)], self.idf)[:2] if own is None else self._set(own)
            other = self._set(h)
            sizes = sorted((float(mine[1].sum()), float(other[1].sum())))
            if sizes[0] < SIMILARITY * sizes[1] * 0.999 or similarity(mine, other) < SIMILARITY:
                continue
            found.append((max(node, self.nodes[h]), min(node, self.nodes[h])))
            if label < 0:
                label = self.label[h]
            else:
                self.label[self.label == self.label[h]] = label


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
    """Batches with their rows as tuples: ((band, i, j), role, number, node, samples)."""
    for batch in batches:
        yield batch, zip(zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True), *(batch.column(c).to_pylist() for c in columns), strict=True)


def _close(rest: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(band, number, i, j, role, node): members of a bucket that some of its rest may be like, by samples alone.

    rest and members(band, number, node, samples, size) are cut into blocks; block i of the rest (role 0)
    meets block j of the members (role 1).
    """
    blocks = lambda df, name: df.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BUCKET_BLOCK), F.ceil(F.sum("size") / BUCKET_BYTES)).cast("int").alias(name))
    sizes = blocks(rest, "of_rest").join(blocks(members, "of_members"), "band")

    def dealt(df: DataFrame, own: str, n: str, other: str, m: str, role: int) -> DataFrame:
        at = F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        return df.join(sizes, "band").withColumn(own, at).withColumn(other, every).select("band", "i", "j", F.lit(role).alias("role"), "number", "node", "samples")

    both = dealt(rest, "i", "of_rest", "j", "of_members", 0).union(dealt(members, "j", "of_members", "i", "of_rest", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, hit = None, None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["band", "number", "i", "j", "role", "node"])

        def waiting() -> list[tuple]:
            return [(key[0], block.number, key[1], key[2], 0, block.nodes[h]) for h in sorted(hit)] if key else []

        for _, rows in _grouped(batches, ("role", "number", "node", "samples")):
            out: list[tuple] = []
            for own, role, number, node, drawn in rows:
                if own != key:
                    out += waiting()
                    key, block, hit = own, _Block(number), set()
                row = np.frombuffer(drawn, dtype=np.uint32)
                if role == 0:
                    block.hold(node, row)
                elif len(near := block.near(node, row)):
                    hit.update(near.tolist())
                    out.append((key[0], number, key[1], key[2], 1, node))
            yield batch_of(out)
        yield batch_of(waiting())

    return both.repartition(width, "band", "i", "j").sortWithinPartitions("band", "i", "j", "role").mapInArrow(run, "band long, number int, i int, j int, role int, node long")


def _compared(close: DataFrame, texts: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """(a, b): links between blocks of the rest and of the members, as far as they join components; the texts
    are verified, the likeliest first, unless links of the same task join them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for batch, rows in _grouped(batches, ("role", "number", "node", "samples")):
            found: list[tuple[int, int]] = []
            own_texts = batch.column("text").cast(pa.binary())
            for k, (own, role, number, node, drawn) in enumerate(rows):
                if own != key:
                    key, bucket = own, _Bucket(number, idf)
                row = np.frombuffer(drawn, dtype=np.uint32)
                if role == 0:
                    bucket.hold(node, row)
                    bucket.texts.append(own_texts[k].as_py())
                else:
                    found += bucket.meet(node, own_texts[k].as_py(), row)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    together = close.join(texts.hint("merge"), "node").select("band", "i", "j", "role", "number", "node", "samples", "text")
    return together.repartition(width, "band", "i", "j").sortWithinPartitions("band", "i", "j", "role").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(sketches, found): sketches as sketch() gives them, found(digest, component, component_id, doc_id, raw) for
    each different normalized text: its component, the least doc_id of that, and its own first row."""
    docs = id_and_text(docs)
    width = shuffle_width(spark)
    idf = inverse_frequencies(docs)
    sketches = stored(sketch(docs, idf), spark, "sketches")
    whole = sketches.where("doc_id is not null and digest is not null")
    # the first row of a text stands for it, under a number that is fixed once the table is written
    firsts = stored(whole.groupBy("digest").agg(F.min(F.struct("doc_id", "raw", "samples", "bands", "size")).alias("f")).select(F.monotonically_increasing_id().alias("node"), "digest", "f.*"), spark, "firsts")
    members = firsts.select("node", "size", F.posexplode("bands").alias("number", "band"))
    heads = members.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head", F.ceil(F.col("n") / HEAD_BLOCK).cast("int").alias("parts"))
    starred = stored(members.join(heads, "band").where("node <> head"), spark, "starred")
    # the texts in question are shuffled once; they and their ids grow with the corpus, so they are merged
    candidates = starred.select("node").union(starred.select("head")).distinct()
    wanted = firsts.join(candidates, "node").select("node", "doc_id", "raw", "samples")
    texts = docs.join(wanted.hint("merge"), "doc_id").where(F.unhex(F.md5("text")) == F.col("raw")).dropDuplicates(["doc_id", "node"])
    texts = stored(texts.select("node", "samples", "text"), spark, "texts")
    pairs = starred.groupBy("node", "head").agg(F.max("parts").alias("parts"))
    alike = stored(verified(pairs, texts.select("node", "text"), idf), spark, "alike")
    rest = starred.join(alike.select("node", "head"), ["node", "head"], "left_anti").select("band", "number", "node", "size")
    drawn = firsts.select("node", "samples")
    rest = stored(rest.join(drawn, "node"), spark, "rest")
    in_question = stored(members.join(rest.select("band").distinct(), "band", "left_semi").join(drawn, "node"), spark, "question")
    close = stored(_close(rest, in_question, width), spark, "close")
    more = _compared(close, texts, idf, width)
    linked = connected_components(alike.select(F.col("node").alias("a"), F.col("head").alias("b")).union(more), lambda df, label: stored(df, spark, label))
    by_text = firsts.select(F.col("node").alias("own"), "digest", "doc_id", "raw").join(linked, F.col("own") == F.col("node"), "left").withColumn("component", F.coalesce("component", "own"))
    # minima are taken before the shuffle, so a component may hold any number of texts
    least = by_text.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return sketches, by_text.join(least, "component").select("digest", "component", "component_id", "doc_id", "raw")


def near_duplicates(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, component_id (the least doc_id that links reach) and kept (doc_id = component_id) of each row."""
    sketches, found = components(docs, spark)
    joined = sketches.where("doc_id is not null and digest is not null").select("doc_id", "digest").join(found.select("digest", "component_id"), "digest").select("doc_id", "component_id")
    alone = sketches.where("doc_id is null or digest is null").select("doc_id", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs, all columns, with the first document of each group of near duplicates (one row of it)."""
    _, found = components(docs, spark)
    id_, raw, word, place, doc_id, own = unused(docs, "id", "raw", "word", "place", "first_id", "first_raw")
    best = found.where("doc_id = component_id").groupBy("component", F.col("doc_id").alias(doc_id)).agg(F.min("raw").alias(own)).select(doc_id, own)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumns({id_: F.col("doc_id").cast("long"), raw: F.unhex(F.md5(text)), word: text.rlike(HAS_WORD) & F.col("doc_id").isNotNull()})
    kept = marked.where(F.col(word)).join(best, (F.col(id_) == F.col(doc_id)) & (F.col(raw) == F.col(own)), "left_semi")
    # of equal texts with one doc_id any row will do; ties are broken by a hash of the other columns
    others = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    order = Window.partitionBy(id_, raw).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in others)))
    first = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return first.select(*columns).union(marked.where(~F.col(word)).select(*columns))
