"""Which terms set a source apart from its language, by chunk factorization.

Texts are split at white space, and chunks are counted per document.  All counts of a chunk meet in one
place, where each globally distinct chunk is split into its terms once; its counts then go on under these
terms.  A term's occurrences are the sums over its chunks.

Distinct documents are not additive over chunks, as one document may hold a term in several.  A kept term needs
LEAST documents, and the numbers by chunk bound that number from both sides: it is at least the largest and at
most the sum.  Chunks of fewer documents than LEAST bring the documents themselves along, so that where the
bounds leave the question open the distinct documents are counted; that covers all chunks of such a term.

Nothing is larger than it should be where one chunk, language or source has a third of all rows: counts are
added up within a task before they travel (a chunk is sent once for a million counts), and merged as a stream;
pairs of sources meet in blocks of sources and terms.

Defined results: null text, lang and source are ''; every row is a document, whatever its doc_id; texts of any
length count as a whole; groups without terms occur in the results; sources with equal values, and equal terms,
are ranked by name; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.llm.common import byte_blocks, distinct_spans, joined, members, packed, ranges, runs_of, stored, unpacked
from facetflow.operators.tables import placed

#: Documents of its language that hold a kept term, at least, and reported terms of a source.
LEAST, MOST_TERMS = 30, 50
SPACE, TERM = members(rb"[\x20\x09-\x0D]"), members(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
BLOCK_BYTES = 4_000_000
#: Counts (document, chunk) that a task adds up before it sends them.
HELD = 1_000_000
#: Sources and terms of a block of the pairwise comparison.
SOURCES, TERMS = 256, 4096

_SOURCE = np.dtype([("g", "<i4"), ("n", "<i8")])
COUNTED = "chunk binary, lang int, docs long, ids binary, sources binary"  # sources: _SOURCE records
_COUNTED = ["chunk", "lang", "docs", "ids", "sources"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _groups(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(lang, source, g, l): every occurring pair with its number, in order, and its language's least."""
    every = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
    numbers = stored(placed(every, [], [F.col("lang"), F.col("source")], "g"), spark, "groups")
    first = numbers.groupBy("lang").agg(F.min("g").alias("l"))
    return stored(numbers.join(first, "lang").select("lang", "source", F.col("g").cast("int"), F.col("l").cast("int")), spark, "groups")


def _merged(names: pa.Array, chunk: np.ndarray, lang: np.ndarray, docs: np.ndarray, id_row: np.ndarray, ids: np.ndarray, source_row: np.ndarray, group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
    """One row for each chunk (a number in names) and language: sums of documents, and of occurrences by group;
    ids of documents stay while there are fewer than LEAST.  id_row and source_row name the rows that ids and
    groups belong to.  Also gives the rows' chunks."""
    width = int(lang.max(initial=0)) + 1
    keys, run = np.unique(chunk * width + lang, return_inverse=True)
    runs = len(keys)
    total = np.zeros(runs, dtype=np.int64)
    np.add.at(total, run, docs)
    few = total < LEAST
    owner = run[id_row]
    stay = few[owner]
    owner, ids = owner[stay], ids[stay]
    order = np.argsort(owner, kind="stable")
    id_column = packed(ids[order].astype("<i8"), np.bincount(owner, minlength=runs))
    owner = run[source_row]
    order = np.lexsort((group, owner))
    owner, group, n = owner[order], group[order], n[order]
    lead = np.ones(len(group), dtype=bool)
    lead[1:] = (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(lead)
    sources = np.empty(len(at), dtype=_SOURCE)
    sources["g"], sources["n"] = group[at], np.add.reduceat(n, at) if len(at) else n
    chunk, lang = np.divmod(keys, width)
    columns = [names.take(pa.array(chunk)).cast(pa.binary()), pa.array(lang, pa.int32()), pa.array(total, pa.int64()), id_column, packed(sources, np.bincount(owner[at], minlength=runs))]
    return chunk, pa.RecordBatch.from_arrays(columns, names=_COUNTED)


class _Counts:
    """Counts of chunks in documents, until they are sent."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.names: list[pa.Array] = []
        self.held = 0

    def add(self, texts: list[bytes], first: int, group: np.ndarray, lang: np.ndarray) -> None:
        raw, offsets = joined(texts)
        starts, ends = runs_of(np.frombuffer(raw, dtype=np.uint8), ~SPACE)
        chunk, names = distinct_spans(raw, starts, ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        key, n = np.unique(doc * max(len(names), 1) + chunk, return_counts=True)
        doc, chunk = np.divmod(key, max(len(names), 1))
        self.rows.append((chunk + sum(map(len, self.names)), group[doc], lang[doc], doc + first, n))
        self.names.append(names)
        self.held += len(n)

    def sent(self) -> pa.RecordBatch:
        chunk, group, lang, doc, n = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        encoded = pa.concat_arrays(self.names).dictionary_encode()
        chunk = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[chunk]
        self.__init__()
        row = np.arange(len(n))
        return _merged(encoded.dictionary, chunk, lang, np.ones(len(n), dtype=np.int64), row, doc, row, group, n)[1]


def count_chunks(docs: DataFrame) -> DataFrame:
    """docs(text, g, l) -> (chunk, lang, docs, ids, sources), added up for about HELD counts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = _Counts(), TaskContext.get().partitionId() << 40
        for batch in batches:
            group, lang = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "l"))
            for a, b, texts in byte_blocks(batch, BLOCK_BYTES):
                counts.add(texts, first, group[a:b], lang[a:b])
                first += b - a
                if counts.held >= HELD:
                    yield counts.sent()
        if counts.held:
            yield counts.sent()

    return docs.mapInArrow(run, COUNTED)


def _terms(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The different terms of each chunk: (chunk, term, times), in the order of chunks, and the terms."""
    raw, offsets = joined(names)
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = runs_of(data, TERM)
    term, terms = distinct_spans(LOWER[data].tobytes(), starts, ends)
    chunk = np.searchsorted(offsets, starts, side="right") - 1
    key, times = np.unique(chunk * max(len(terms), 1) + term, return_counts=True)
    chunk, term = np.divmod(key, max(len(terms), 1))
    return chunk, term, times, terms.cast(pa.binary()).cast(pa.string())


def _by_terms(chunk: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Merged rows under the terms of their chunks; chunk numbers the rows' chunks from 0 without a gap."""
    first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    owner, term, times, terms = _terms(rows.column("chunk").take(pa.array(first)).to_pylist())
    counts = np.bincount(owner, minlength=len(first))
    begins = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(chunk)), counts[chunk])
    pair = ranges(begins[chunk], counts[chunk])
    data, sizes = unpacked(rows.column("sources").take(pa.array(row)), _SOURCE)
    data = data.copy()
    data["n"] *= np.repeat(times[pair], sizes)
    taken = [rows.column(c).take(pa.array(row)) for c in ("lang", "docs", "ids")]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(term[pair])), *taken, packed(data, sizes)], names=["term", "lang", "docs", "ids", "sources"])


def count_terms(chunks: DataFrame) -> DataFrame:
    """(term, lang, docs, ids, sources): one row for each different chunk, language and term of the chunk.

    Equal chunks come one after the other; their rows are merged as they come, so that a chunk holds a task up
    with one row a language, however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.concat_batches([waiting.cast(batch.schema), batch])
            names = batch.column("chunk")
            number = np.zeros(len(names), dtype=np.int64)
            number[1:] = np.cumsum(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
            lead = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            ids, id_sizes = unpacked(batch.column("ids"), "<i8")
            sources, source_sizes = unpacked(batch.column("sources"), _SOURCE)
            row = np.arange(len(names))
            lang, docs = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lang", "docs"))
            chunk, rows = _merged(names.take(pa.array(lead)), number, lang, docs, np.repeat(row, id_sizes), ids, np.repeat(row, source_sizes), sources["g"].astype(np.int64), sources["n"])
            last = int(np.searchsorted(chunk, chunk[-1]))
            waiting = rows.slice(last)
            if last:
                yield _by_terms(chunk[:last], rows.slice(0, last))
        if waiting is not None:
            yield _by_terms(np.zeros(waiting.num_rows, dtype=np.int64), waiting)

    return chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "term string, lang int, docs long, ids binary, sources binary")


def kept_terms(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of the terms that at least so many (LEAST at most) documents of the language hold."""
    if least > LEAST:
        raise ValueError(f"documents are told apart below {LEAST} only")
    bounds = counted.groupBy("lang", "term").agg(F.max("docs").alias("most"), F.sum("docs").alias("sum"))
    sure = bounds.where(F.col("most") >= least).select("lang", "term")
    open_ = counted.join(bounds.where((F.col("most") < least) & (F.col("sum") >= least)).select("lang", "term"), ["lang", "term"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = unpacked(batch.column("ids"), "<i8")
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(row), batch.column("term").take(row), pa.array(ids)], names=["lang", "term", "doc"])

    held = open_.select("lang", "term", "ids").mapInArrow(run, "lang int, term string, doc long").distinct()
    return sure.union(held.groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "term"))


def group_counts(counted: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, g, term, n): occurrences of the kept terms in each group that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, sizes = unpacked(batch.column("sources"), _SOURCE)
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(row), pa.array(sources["g"].copy()), batch.column("term").take(row), pa.array(sources["n"].copy())], names=["lang", "g", "term", "n"])

    rows = counted.join(kept, ["lang", "term"]).select("lang", "term", "sources")
    return rows.mapInArrow(run, "lang int, g int, term string, n long").groupBy("lang", "g", "term").agg(F.sum("n").alias("n"))


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)), exactly; null without kept terms."""
    return F.expr(f"IF(v = 0, NULL, 1 + (CAST(1000000000 AS DECIMAL(18, 0)) * (CAST({n} AS DECIMAL(19, 0)) + 5)) div (CAST({total} AS DECIMAL(19, 0)) + 5 * v))")


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| between two blocks of a language's groups, over a block of its terms.

    Rows without a term are the groups, with the share of a term that they don't hold and the number of terms."""
    first, second, lang = (int(rows[c].iloc[0]) for c in ("first", "second", "lang"))
    is_group = rows["term"].isna()
    groups = rows[is_group].sort_values("g")
    g, rest = groups["g"].to_numpy(), groups["p"].to_numpy(dtype=np.int64)
    held = rows[~is_group]
    term, names = pd.factorize(held["term"])
    # a row more stands for each term that no group here holds
    p = np.repeat(rest[:, None], len(names), axis=1)
    p[np.searchsorted(g, held["g"].to_numpy()), term] = held["p"].to_numpy(dtype=np.int64)
    absent = int(groups["terms"].iloc[0]) - len(names)
    block = (g - lang) // SOURCES
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out = []
    for i in left:
        own = right[right != i]
        value = np.abs(p[own] - p[i]).sum(axis=1) + absent * np.abs(rest[own] - rest[i])
        out.append(pd.DataFrame({"g": g[i], "other": g[own], "value": value}))
        if first != second:
            out.append(pd.DataFrame({"g": g[own], "other": g[i], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"g": [], "other": [], "value": []})


def _pairs(groups: DataFrame, kept: DataFrame, shares: DataFrame) -> DataFrame:
    """(g, other, value) for all other groups of the language."""
    bucket = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("long")).cast("int")
    languages = groups.select("lang", "v", "groups").distinct()
    sizes = kept.join(languages, "lang").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("terms"))
    every = languages.select("lang", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int") - 1)).alias("bucket"))
    every = every.join(sizes, ["lang", "bucket"], "left").select("lang", "bucket", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    own = groups.join(every, "lang").select("lang", "bucket", "g", "groups", F.lit(None).cast("string").alias("term"), F.coalesce("rest", F.lit(0).cast("long")).alias("p"), "terms")
    held = shares.select("lang", bucket.alias("bucket"), "g", "groups", "term", "p", F.lit(None).cast("long").alias("terms"))
    mine = F.floor((F.col("g") - F.col("lang")) / SOURCES).cast("int")
    blocks = F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / SOURCES).cast("int"))
    dealt = own.union(held).withColumn("_other", F.explode(blocks)).withColumn("first", F.least(mine, "_other")).withColumn("second", F.greatest(mine, "_other"))
    sums = dealt.select("lang", "bucket", "first", "second", "g", "term", "p", "terms").groupBy("lang", "bucket", "first", "second").applyInPandas(_distances, "g int, other int, value long")
    return sums.groupBy("g", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """lang, source, part, item, value, rank: by how much the shares of terms differ between a source and each
    other source of its language (part pair), and the terms that it has more of than its language (part term)."""
    groups = _groups(docs, spark)
    texts = docs.select(_text("text").alias("text"), _text("lang").alias("lang"), _text("source").alias("source"))
    chunks = count_chunks(texts.join(groups, ["lang", "source"]).select("text", "g", "l"))
    counted = stored(count_terms(chunks), spark, "terms")
    kept = stored(kept_terms(counted), spark, "kept")
    counts = stored(group_counts(counted, kept), spark, "counts")
    zero = F.lit(0).cast("long")
    languages = groups.groupBy("l").agg(F.count("*").alias("groups"))
    vocabulary = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("v"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    known = groups.join(languages, "l").join(vocabulary, "l", "left").join(totals, "g", "left").select(F.col("l").alias("lang"), "g", "groups", F.coalesce("v", zero).alias("v"), F.coalesce("total", zero).alias("total"))
    known = stored(known.withColumn("rest", _share("0", "total")), spark, "known")
    shares = counts.join(known.drop("rest"), ["lang", "g"]).withColumn("p", _share("n", "total"))
    whole = known.groupBy("lang", "v").agg(F.sum("total").alias("total"))
    usual = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", _share("n", "total").alias("q"))
    above = shares.join(usual, ["lang", "term"]).where("p > q").select("g", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_TERMS)
    names = groups.select("g", "lang", "source")
    others = groups.select(F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = _pairs(known, kept, shares).join(others, "other").select("g", "item", "value").withColumn("rank", F.row_number().over(order))
    both = terms.select("g", F.lit("term").alias("part"), "item", "value", "rank").union(pairs.select("g", F.lit("pair"), "item", "value", "rank"))
    return both.join(names, "g").select("lang", "source", "part", "item", "value", "rank")


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(p.n)::HUGEINT + 5)) // (any_value(t.total) + 5 * any_value(v.v)) AS q
      FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM s GROUP BY lang) t USING (lang) GROUP BY lang, term),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM t UNION ALL SELECT * FROM x))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
