"""Ranked lexical search over an index by length.

The score of a term in a document depends on its number tf there and on the document's normaliser m, a step
function of its length.  So documents with equal m form a stratum, within which a term's postings are kept by
tf, and the impact of a tf is computed once for all documents that share it.  The largest tf of each term bounds
what an item's terms can add up to in a stratum; items visit strata by falling bounds, and leave out those
whose bound is below the least score that they have to beat.

- Documents are dealt by ranges of their lengths that hold about equal numbers of bytes, and a range that holds
  more is dealt again at random, so a stratum of any size is cut over as many tasks as it needs; what one task
  holds of a stratum is a shard, with a header (terms, documents and largest tf by term) and
  postings apart from it.
- Items are answered in blocks of a bounded number of terms, each against the whole index: a first pass over
  headers counts the documents of each term, a second one visits every task's best shard for each item and so
  finds a score that ten documents reach, and a third visits all shards whose bound is not below it.
- Scores are 64-bit integers, added up exactly, so equal ones tie exactly.

Defined results: null and empty texts have no terms and are in no result, nor counted among the documents; rows
without a doc_id or item_id take no part; rows that repeat a doc_id are documents each by itself; rows that
repeat an item_id are one item with the terms of all; items without terms, or whose terms occur nowhere, get no
rows; texts of any length are indexed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.llm.common import byte_blocks, distinct_spans, id_and_text, joined, members, mix64, ranges, runs_of, shuffle_width, stored
from facetflow.operators.tables import placed, running_sum

BEST = 10
TERM = members(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Bytes of text, and documents, of a block that is indexed at once; a shard is no larger.
BLOCK_BYTES, BLOCK_DOCS = 1_500_000, 60_000
#: Bytes of text for which there is one index partition, and bytes of shards that are visited together.
PARTITION_BYTES, HELD_BYTES = 16_000_000, 16_000_000
#: Terms of a block of items; an item counts as ITEM_TERMS more.
BLOCK_TERMS, ITEM_TERMS = 100_000, 100
#: Postings that are scored, and scores that are held, at once.
AT_ONCE = 1_000_000
#: Tasks whose best documents of an item meet before those of all tasks do.
TASKS = 256

_INDEX = "m long, docs binary, terms binary, ends binary, counts binary, largest binary, postings binary"
_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


@dataclass
class Index:
    """A stored table of shards, the number of documents with terms, and that of their terms."""

    shards: DataFrame
    documents: int
    terms: int


def _cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, starts and ends of their terms, and the text of each term."""
    raw, offsets = joined(texts)
    data = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends = runs_of(data, TERM)
    return data.tobytes(), starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _kind(n: np.ndarray) -> np.ndarray:
    """Numbers of terms by size, sixteen kinds each time they double: at most a thousand kinds."""
    return np.floor(16 * np.log2(n)).astype(np.int64)


def _dealt(docs: DataFrame, documents: int, terms: int, first: np.ndarray, wide: np.ndarray) -> DataFrame:
    """doc_id, text, m and slot of the documents with terms: those of kind k go to wide[k] slots from first[k]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.uint64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.bincount(_cut(texts)[3], minlength=b - a) for a, b, texts in byte_blocks(batch, BLOCK_BYTES))])
            at = np.flatnonzero(n)
            kind = _kind(n[at])
            # by the place in the input, so that rows that repeat one id part, too
            slot = first[kind] + (mix64(row + at.astype(np.uint64)) % wide[kind].astype(np.uint64)).astype(np.int64)
            row += np.uint64(len(n))
            m = [10 + (90 * x * documents) // terms for x in n[at].tolist()]
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(m, pa.int64()), pa.array(slot)], names=["doc_id", "text", "m", "slot"])

    return docs.mapInArrow(run, "doc_id long, text string, m long, slot long")


def _totals(docs: DataFrame) -> list[tuple[int, int, int, int]]:
    """By kind of length: documents with terms, their terms, and bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1024), dtype=np.int64)
        for batch in batches:
            for a, b, texts in byte_blocks(batch, BLOCK_BYTES):
                n = np.bincount(_cut(texts)[3], minlength=b - a)
                at = np.flatnonzero(n)
                sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                for own, values in zip(sums, (np.ones(len(at), np.int64), n[at], sizes[at]), strict=True):
                    np.add.at(own, _kind(n[at]), values)
        kinds = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(x[kinds]) for x in sums)], names=["kind", "n", "l", "size"])

    rows = docs.mapInArrow(run, "kind long, n long, l long, size long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "l", "size")))
    return [tuple(r) for r in rows.orderBy("kind").collect()]


def _slots(totals: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """First slot and number of slots of each kind, and how many there are: about PARTITION_BYTES each."""
    first, wide = np.zeros(1024, dtype=np.int64), np.ones(1024, dtype=np.int64)
    slot, filled = 0, 0
    for kind, _, _, size in totals:
        parts = -(-size // PARTITION_BYTES)
        if filled and filled + size > PARTITION_BYTES:
            slot, filled = slot + 1, 0
        first[kind], wide[kind] = slot, max(1, parts)
        if parts > 1:
            slot, filled = slot + parts, 0
        else:
            filled += size
    return first, wide, slot + 1


def _shards(ids: np.ndarray, m: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
    """The shards of a block of documents, ordered by m and id."""
    squeeze = zstandard.ZstdCompressor(level=1)
    raw, starts, ends, doc = _cut(texts)
    term, names = distinct_spans(raw, starts, ends)
    key, tf = np.unique(doc * max(len(names), 1) + term, return_counts=True)
    doc, term = np.divmod(key, max(len(names), 1))
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    stratum = np.searchsorted(first, doc, side="right") - 1
    order = np.lexsort((doc, tf, term, stratum))
    doc, term, tf, stratum = doc[order], term[order], tf[order], stratum[order]
    cuts = np.searchsorted(stratum, np.arange(len(first) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        low = first[k]
        high = first[k + 1] if k + 1 < len(first) else len(ids)
        own_term, own_tf = term[a:b], tf[a:b]
        lead = np.append(True, own_term[1:] != own_term[:-1])
        group = lead | np.append(True, own_tf[1:] != own_tf[:-1])
        at, group_at = np.flatnonzero(lead), np.flatnonzero(group)
        strings = names.take(pa.array(own_term[at]))
        last = np.append(at[1:], b - a)
        sizes = np.diff(np.append(group_at, b - a))
        heads = np.array([len(group_at), b - a], dtype="<i8").tobytes()
        body = heads + own_tf[group_at].astype("<u4").tobytes() + sizes.astype("<u2").tobytes() + (doc[a:b] - low).astype("<u2").tobytes()
        lengths = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
        yield (
            int(m[low]), ids[low:high].astype("<i8").tobytes(), squeeze.compress(b"".join(strings.to_pylist())), np.cumsum(lengths).astype("<u4").tobytes(),
            (last - at).astype("<u2").tobytes(), own_tf[last - 1].astype("<u4").tobytes(), squeeze.compress(body),
        )


def build_index(docs: DataFrame, spark: SparkSession) -> Index:
    """Indexes every document: texts are dealt by length and cut into terms where they arrive."""
    docs = id_and_text(docs).where(F.col("doc_id").isNotNull())
    totals = _totals(docs)
    documents, terms = sum(t[1] for t in totals), sum(t[2] for t in totals)
    first, wide, slots = _slots(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        ms: list[np.ndarray] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            rows = list(_shards(np.concatenate(ids), np.concatenate(ms), texts))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.binary()] * 6, strict=True)], names=_COLUMNS)

        for batch in batches:
            own_ids, own_m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "m"))
            for a, b, own in byte_blocks(batch, BLOCK_BYTES):
                if texts and (size + sum(map(len, own)) > BLOCK_BYTES or len(texts) + len(own) > BLOCK_DOCS):
                    yield made()
                    ids, ms, texts, size = [], [], [], 0
                for i in range(a, b, BLOCK_DOCS):
                    part = own[i - a : i - a + BLOCK_DOCS]
                    if texts and len(texts) + len(part) > BLOCK_DOCS:
                        yield made()
                        ids, ms, texts, size = [], [], [], 0
                    ids.append(own_ids[i : i + len(part)])
                    ms.append(own_m[i : i + len(part)])
                    texts += part
                    size += sum(map(len, part))
        if texts:
            yield made()

    dealt = _dealt(docs, documents, terms, first, wide).repartition(max(shuffle_width(spark), slots), "slot").sortWithinPartitions("m", "doc_id")
    return Index(stored(dealt.select("m", "doc_id", "text").mapInArrow(run, _INDEX), spark, "shards"), documents, terms)


class _Items:
    """A block of items: their terms by number, and which item has which."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        rows = sorted(rows)
        self.ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.ids)}
        self.names = sorted({t for _, t in rows})
        at = {t: k for k, t in enumerate(self.names)}
        self.item = np.array([number[i] for i, _ in rows], dtype=np.int64)
        self.term = np.array([at[t] for _, t in rows], dtype=np.int64)
        self.first = np.searchsorted(self.item, np.arange(len(self.ids)))
        self.weight = np.zeros(len(self.names), dtype=np.int64)


class _Shard:
    """A shard as it is read: its header, and its postings once they are wanted."""

    def __init__(self, row: dict, items: _Items, names: pa.Array):
        self.row = row
        self.m = row.get("m")
        ends = np.frombuffer(row["ends"], dtype="<u4").astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["terms"])
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).tobytes()), pa.py_buffer(raw)])
        #: the place of each of the items' terms among the shard's, -1 for none
        self.place = pc.fill_null(pc.index_in(names, value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.frombuffer(row["counts"], dtype="<u2").astype(np.int64)

    def impact(self, tf: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.m)

    def bounds(self, items: _Items) -> np.ndarray:
        most = np.append(self.impact(np.frombuffer(self.row["largest"], dtype="<u4")), 0)
        return np.add.reduceat((items.weight * most[self.place])[items.term], items.first)

    def scores(self, items: _Items, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, document, score) of all documents that the wanted items' terms meet, some items at a time."""
        body = zstandard.ZstdDecompressor().decompress(self.row["postings"])
        groups, n = np.frombuffer(body[:16], dtype="<i8")
        tf, rest = np.frombuffer(body[16 : 16 + 4 * groups], dtype="<u4"), body[16 + 4 * groups :]
        sizes, docs = np.frombuffer(rest[: 2 * groups], dtype="<u2"), np.frombuffer(rest[2 * groups :], dtype="<u2").astype(np.int64)
        impacts = np.repeat(self.impact(tf), sizes)
        begins = np.cumsum(self.counts) - self.counts
        ids = np.frombuffer(self.row["docs"], dtype="<i8")
        pair = np.flatnonzero(np.isin(items.item, wanted) & (self.place[items.term] >= 0))
        item, term = items.item[pair], items.term[pair]
        place = self.place[term]
        # as many items at a time as fit: by postings, and by scores
        lead = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        load = np.maximum(np.add.reduceat(self.counts[place], lead), len(ids)) if len(lead) else lead
        block = (np.cumsum(load) - load) // AT_ONCE
        for k in np.unique(block):
            some = np.flatnonzero(block == k)
            a, b = lead[some[0]], lead[some[-1] + 1] if some[-1] + 1 < len(lead) else len(item)
            length = self.counts[place[a:b]]
            at = ranges(begins[place[a:b]], length)
            slot = np.searchsorted(item[lead[some]], item[a:b])
            total = np.zeros(len(some) * len(ids), dtype=np.int64)
            np.add.at(total, np.repeat(slot * len(ids), length) + docs[at], np.repeat(items.weight[term[a:b]], length) * impacts[at])
            found = np.flatnonzero(total)
            yield item[lead[some]][found // len(ids)], ids[found % len(ids)], total[found]


class _Best:
    """The best documents of each item so far, and the score that they have to reach."""

    def __init__(self, items: int, least: np.ndarray):
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items
        self.least = np.maximum(least, 1)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[item]
        item, doc, score = item[keep], doc[keep], score[keep]
        if not len(item):
            return
        cuts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(item)], strict=True):
            i = item[a]
            docs, scores = np.concatenate([self.rows[i][0], doc[a:b]]), np.concatenate([self.rows[i][1], score[a:b]])
            top = np.lexsort((docs, -scores))[:BEST]
            self.rows[i] = docs[top], scores[top]
            if len(top) == BEST:
                self.least[i] = max(self.least[i], scores[top[-1]])


def _visited(index: DataFrame, items: _Items, least: np.ndarray, first: bool) -> DataFrame:
    """(task, item_id, doc_id, score): each task's best documents of every item.  With first only from the shard
    with the highest bound of those held together, else from all whose bound reaches the score to beat."""
    names = pa.array(items.names, pa.large_binary())

    def visit(held: list[_Shard], best: _Best) -> None:
        bounds = np.array([s.bounds(items) for s in held])
        # each item's shards by falling bounds: visits come in rounds of one, two, four, ... of each item's
        order = np.argsort(-bounds, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(held))[:, None], order.shape), axis=0)
        low, wide = 0, 1
        while low < len(held):
            for s, shard in enumerate(held):
                wanted = np.flatnonzero((place[s] >= low) & (place[s] < low + wide) & (bounds[s] >= best.least))
                if len(wanted):
                    for found in shard.scores(items, wanted):
                        best.add(*found)
            low, wide = low + wide, 2 * wide
            if first:
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = _Best(len(items.ids), least), [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                held.append(_Shard(own, items, names))
                size += sum(len(v) for v in own.values() if isinstance(v, bytes)) + held[-1].place.nbytes
                if size >= HELD_BYTES:
                    visit(held, best)
                    held, size = [], 0
        if held:
            visit(held, best)
        n = [len(d) for d, _ in best.rows]
        ids = np.repeat(np.array(items.ids, dtype=np.int64), n)
        docs, scores = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in best.rows)]) for k in (0, 1))
        task = np.full(len(ids), TaskContext.get().partitionId() // TASKS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (task, ids, docs, scores)], names=["task", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "task long, item_id long, doc_id long, score long")


def _top(found: DataFrame) -> DataFrame:
    """The best of each item, with their rank: those of some tasks first, then of all."""
    some = Window.partitionBy("item_id", "task").orderBy(F.desc("score"), "doc_id")
    every = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    few = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= BEST)
    return few.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def _weights(index: Index, items: _Items) -> np.ndarray:
    """Weights of the items' terms, from the number of documents that hold each."""
    names = pa.array(items.names, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(items.names), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Shard({c: batch.column(c)[row].as_py() for c in batch.schema.names}, items, names)
                n += np.append(shard.counts, 0)[shard.place]
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["term", "n"])

    rows = index.shards.select("terms", "ends", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(len(items.names), dtype=np.int64)
    for row in rows:
        weights[row["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * row["n"] + 1)))
    return weights


def _item_blocks(items: DataFrame, spark: SparkSession) -> DataFrame:
    """(item_id, term, block): the different terms of each item, blocks with about BLOCK_TERMS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in byte_blocks(batch, BLOCK_BYTES):
                raw, starts, ends, owner = _cut(texts)
                term, names = distinct_spans(raw, starts, ends)
                key = np.unique(owner * max(len(names), 1) + term)
                owner, term = np.divmod(key, max(len(names), 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner + a)), names.take(pa.array(term)).cast(pa.binary())], names=["item_id", "term"])

    terms = items.mapInArrow(run, "item_id long, term binary").distinct()
    terms = stored(terms, spark, "item-terms")
    sizes = placed(terms.groupBy("item_id").agg(F.count("*").alias("n")), [], [F.col("item_id")], "place")
    upto = running_sum(sizes, [], "place", F.col("n") + ITEM_TERMS, "upto")
    block = F.floor((F.col("upto") - F.col("n") - ITEM_TERMS) / BLOCK_TERMS).cast("long")
    return stored(terms.join(upto.select("item_id", block.alias("block")), "item_id"), spark, "item-blocks")


def search(index: Index, items: DataFrame, spark: SparkSession) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item(item_id, text)."""
    renamed = id_and_text(items.select(F.col("item_id").alias("doc_id"), "text")).where(F.col("doc_id").isNotNull())
    blocks = _item_blocks(renamed, spark)
    last = blocks.agg(F.max("block")).first()[0]
    out: list[DataFrame] = []
    for block in range(0 if last is None else last + 1):
        rows = blocks.where(F.col("block") == block).select("item_id", "term").collect()
        if not rows:
            continue
        own = _Items([(r["item_id"], bytes(r["term"])) for r in rows])
        own.weight = _weights(index, own)
        none = np.zeros(len(own.ids), dtype=np.int64)
        reached = _top(_visited(index.shards, own, none, True)).where(F.col("rank") == BEST).collect()
        number = {i: k for k, i in enumerate(own.ids)}
        for row in reached:
            none[number[row["item_id"]]] = row["score"]
        found = _top(_visited(index.shards, own, none, False))
        out.append(stored(found, spark, "found") if last else found)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


#: The same rows in DuckDB.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
           FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT r, doc_id, len(ws) AS n FROM w WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM d),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // l AS m FROM d, s),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM i JOIN f USING (term), s),
x AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM t JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
