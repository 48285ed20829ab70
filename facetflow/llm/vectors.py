"""Embedding near-dedup: an exact metric range join.

On unit vectors, cosine >= COSINE is a distance of at most R.  Every vector lives in the cell of its
nearest pivot.  If x lives in cell i and a vector of cell j lies within R of it, the triangle inequality
gives d(x, p_j) <= d(x, p_i) + 2 R; in Euclidean space it also holds that x lies within R of the plane
halfway between p_i and p_j.  So x goes to those other cells only, and each cell is joined by itself.
Either end of a link could go to the other's cell; of two cells, taken in a circle, only the vectors of
the one that has the other in the half ahead of it go, so every link is found once.

- Equal vectors are collapsed first, so a vector with any number of copies is one row.
- A cell with many vectors is split: a task holds CELL vectors and streams what may be near them.
- A cell sends links on as a forest (each vector with its component's root), not as pairs.
- Vectors travel in the type they are stored in; lengths and cosines are computed in double precision.

Defined results: vectors that are null, zero, without vec_id, or hold null or non-finite components link
with nothing; so do vectors of different lengths; an empty table gives an empty result.  Rows that repeat
a vec_id are vectors of their own with one component; if different vectors share it, each shows the links
of all of them.  Ties of a cell go to its first pivot.  Columns other than vec_id and embedding are not read.

Cells are made for the eight commonest vector lengths; vectors of rarer lengths make one cell a length,
which is split as any other: the result is the same, only no pivot spares comparisons.  Where vectors
spread evenly over many dimensions, R is wide next to their distances, nearly every vector goes to half
of the cells, and the join costs what comparing all pairs in blocks costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm.common import shuffle_width, stored
from facetflow.operators.graph import connected_components

COSINE = 0.95
CELL = 6000
MOST_PIVOTS = 1024
#: How far single precision may be off; closer cases are settled in double precision.
UNSURE = 1e-4


def _is_usable(v: Column) -> Column:
    """Whether a vector can link; never null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, usable): single precision stays, everything else becomes double."""
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return named.withColumn("usable", F.col("vec_id").isNotNull() & _is_usable(F.col("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; the largest component is brought to 1 first, so that squares neither vanish nor overflow."""
    raw = np.stack([np.asarray(x, dtype=np.float64) for x in column.to_numpy(zero_copy_only=False)])
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _cells(unique: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cell, home, id, n, v): a row for the cell a vector lives in and for each ahead that it may reach."""
    kind = unique.schema["v"].dataType.simpleString()
    reach = math.sqrt(2 - 2 * COSINE) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                if dim in pivots:
                    p = pivots[dim]
                    square = np.maximum(2 - 2 * (_matrix(part.column("v")) @ p.T), 0)
                    home = square.argmin(axis=1)
                    least = square[np.arange(len(rows)), home]
                    gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
                    near = square - least[:, None] <= 2 * reach * gap
                    near &= np.sqrt(square) <= np.sqrt(least)[:, None] + 2 * reach
                    ahead = (np.arange(len(p)) - home[:, None]) % len(p)
                    near &= (2 * ahead < len(p)) | ((2 * ahead == len(p)) & (home[:, None] < np.arange(len(p))))
                    near[np.arange(len(rows)), home] = True
                    who, cell = np.nonzero(near)
                else:
                    who, home = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
                    cell = home
                for k in range(0, len(who), 20_000):
                    w, c = who[k : k + 20_000], cell[k : k + 20_000]
                    own = part.take(pa.array(w))
                    yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(c, pa.int32()), pa.array(home[w] == c), own.column("id"), own.column("n"), own.column("v")], names=["dim", "cell", "home", "id", "n", "v"])

    return unique.mapInArrow(run, f"dim int, cell int, home boolean, id long, n long, v {kind}")


class Forest:
    """Components of numbered items whose links arrive in blocks."""

    def __init__(self) -> None:
        self.label = np.zeros(0, dtype=np.int64)

    def grow(self, n: int) -> None:
        self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + n)])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def _joined(cells: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """(a, b, links): for vectors with links (a = b) how many this task found; for linked ones their root b.

    sizes(dim, cell, parts) has a row for each cell that is split: a stored table, so that the join knows
    its size.  Parts of a cell meet once, too: of two, in a circle, the vectors of the
    one that has the other in the half ahead of it stream to the other.
    """
    parts = F.coalesce("parts", F.lit(1))
    dealt = cells.join(sizes, ["dim", "cell"], "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    held = dealt.where("home").withColumn("part", F.col("own")).withColumn("role", F.lit(0))
    ahead = F.pmod(F.col("part") - F.col("own"), F.col("parts"))
    first = (2 * ahead < F.col("parts")) | ((2 * ahead == F.col("parts")) & (F.col("own") < F.col("part")))
    streamed = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(~F.col("home") | first)
    # role 1: from this part itself, 2: from elsewhere
    streamed = streamed.withColumn("role", F.when(F.col("home") & (F.col("own") == F.col("part")), 1).otherwise(2))
    columns = ["dim", "cell", "part", "role", "id", "n", "v"]
    rows = held.select(columns).union(streamed.select(columns)).repartition(width, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, None
        for batch in batches:
            dims, cells_, parts_, roles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "part", "role"))
            marks = np.stack([dims, cells_, parts_, roles])
            cuts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            for i, j in zip(cuts, np.append(cuts[1:], len(roles)), strict=True):
                if key != tuple(marks[:3, i]):
                    if task is not None:
                        yield task.result()
                    key, task = tuple(marks[:3, i]), _Cell()
                for k in range(i, j, 1000):
                    own = batch.slice(k, min(1000, j - k))
                    task.take(roles[i], own.column("id").to_numpy(zero_copy_only=False), own.column("n").to_numpy(zero_copy_only=False), _matrix(own.column("v")))
        if task is not None:
            yield task.result()

    return rows.mapInArrow(run, "a long, b long, links long")


class _Cell:
    """Held vectors of one cell, and their links to the vectors that stream by."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.copies: list[np.ndarray] = []
        self.matrix: np.ndarray | None = None

    def take(self, role: int, ids: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
        if role == 0:
            self.ids.append(ids)
            self.rows.append(rows)
            self.copies.append(n)
            return
        if self.matrix is None:
            self.matrix = np.concatenate(self.rows) if self.rows else np.zeros((0, rows.shape[1]))
            self.single = self.matrix.astype(np.float32)
            self.all_ids = [np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.int64)]
            self.held = self.all_ids[0]
            self.n = np.concatenate(self.copies) if self.copies else np.zeros(0, dtype=np.int64)
            self.links = np.zeros(len(self.held), dtype=np.int64)
            #: streamed vectors with links: ids and numbers of links
            self.others: list[tuple[np.ndarray, np.ndarray]] = []
            self.forest = Forest()
            self.forest.grow(len(self.held))
        cosine = self.single @ rows.astype(np.float32).T
        h, x = np.nonzero(cosine >= COSINE - UNSURE)
        unsure = np.flatnonzero(np.abs(cosine[h, x] - COSINE) <= UNSURE)
        good = np.ones(len(h), dtype=bool)
        good[unsure] = np.einsum("ij,ij->i", self.matrix[h[unsure]], rows[x[unsure]]) >= COSINE
        good &= self.held[h] != ids[x]
        h, x = h[good], x[good]
        if not len(h):
            return
        self.links += np.bincount(h, weights=n[x], minlength=len(self.held)).astype(np.int64)
        linked, place = np.unique(x, return_inverse=True)
        if role == 2:  # those of this part itself are held, and counted as such
            self.others.append((ids[linked], np.bincount(place, weights=self.n[h]).astype(np.int64)))
        first = len(self.forest.label)
        self.forest.grow(len(linked))
        self.all_ids.append(ids[linked])
        self.forest.link(h, first + place)

    def result(self) -> pa.RecordBatch:
        if self.matrix is None:
            a = b = links = np.zeros(0, dtype=np.int64)
        else:
            everyone = np.concatenate(self.all_ids)
            root = everyone[self.forest.label]
            other = root != everyone
            some = self.links > 0
            own = np.concatenate([self.held[some], *(i for i, _ in self.others)])
            a, b = np.concatenate([own, everyone[other]]), np.concatenate([own, root[other]])
            links = np.concatenate([self.links[some], *(n for _, n in self.others), np.zeros(int(other.sum()), dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])


def range_join(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, see the module."""
    named = _named(vectors)
    usable = named.where("usable").select("vec_id", "v")
    unique = stored(usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "n", "v", F.size("v").alias("dim")), spark, "vectors")
    pivots: dict[int, np.ndarray] = {}
    for row in unique.groupBy("dim").agg(F.count("*").alias("n")).where(f"n > {CELL}").orderBy(F.desc("n")).limit(8).collect():
        wanted = min(MOST_PIVOTS, -(-row["n"] // CELL))
        chosen = unique.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
        p = np.array([r["v"] for r in chosen], dtype=np.float64)
        pivots[row["dim"]] = p / np.sqrt((p * p).sum(axis=1))[:, None]
    cells = _cells(unique, pivots)
    sizes = stored(cells.where("home").groupBy("dim", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")).where("parts > 1"), spark, "sizes")
    joined = stored(_joined(cells, sizes, max(shuffle_width(spark), len(pivots))), spark, "links")
    component = connected_components(joined.where("a <> b").select("a", "b"), lambda df, label: stored(df, spark, label))
    links = joined.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    settled = unique.select("v", "id", "n").join(links, "id", "left").join(component, F.col("id") == F.col("node"), "left")
    none = F.lit(0).cast("long")
    settled = settled.select("v", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", none) + F.col("n") - 1).alias("n_links"))
    found = usable.join(settled, "v").select("vec_id", "n_links", "component_id")
    unusable = named.where(~F.col("usable")).select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(unusable).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same rows in DuckDB.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a, v AS b
      WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reached.c FROM reached JOIN l ON reached.n = l.a),
least AS (SELECT n, min(c) AS c FROM reached GROUP BY n),
degree AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings AS e JOIN least ON e.vec_id = least.n LEFT JOIN degree ON e.vec_id = degree.a
"""
