"""Choosing collapses that can be made at once, and making them.

A collapse writes its two ends and reads all their neighbours.  Two collapses conflict if one writes what
the other reads; then the cheaper one goes first.  Ranks are total, so one round keeps the collapses
that no conflicting one precedes, and rounds until nothing is left keep what a greedy pass in the order
of ranks would keep.  A vertex only has to know the least rank that writes it, so no pairs are formed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions import vecmath as M
from facetflow.operators.quadrics import rank_of
from facetflow.operators.tables import discard, placed, stored
from facetflow.operators.topology import neighbours

#: No table that can be held needs as many rounds.
MOST_ROUNDS = 100_000
#: After so many rounds their results are stored as one table, so that plans stay short.
MERGE_EVERY = 20
#: Rows (collapse, vertex) that one task may hold: a few megabytes.
SETTLED = 200_000


def _rank_columns() -> tuple[Column, ...]:
    return M.tidy(F.col("cost")), F.col("hi"), F.col("lo")


def independent_batch(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidates (mesh_id, hi, lo, ..., cost) that precede all they conflict with: one round.

    The least rank that writes a vertex or a neighbour of it is all that a vertex has to know: no rows for what a
    collapse reads are formed."""
    ranked = candidates.withColumn("_rank", rank_of())
    written = stored(ranked.select("mesh_id", "_rank", F.explode(F.array("hi", "lo")).alias("v")).groupBy("mesh_id", "v").agg(F.min("_rank").alias("first")), "written")
    around = edges.select("mesh_id", F.inline(F.array(F.struct(F.col("src").alias("n"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("n"), F.col("src").alias("v")))))
    near = around.join(written.withColumnRenamed("v", "n"), ["mesh_id", "n"]).select("mesh_id", "v", "first").union(written.select("mesh_id", "v", "first"))
    least = stored(near.groupBy("mesh_id", "v").agg(F.min("first").alias("first")), "least")
    for end in ("hi", "lo"):
        ranked = ranked.join(least.select("mesh_id", F.col("v").alias(end), F.col("first").alias(f"_{end}")), ["mesh_id", end])
    return ranked.where("_hi >= _rank and _lo >= _rank").select(candidates.columns)


def greedy_batch(candidates: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """What a greedy pass in the order of ranks keeps: every candidate is kept or conflicts with a kept one.

    Rounds keep what no conflicting one precedes.  Where costs tie over a wide area, choices follow one another
    in a chain, and rounds grow with its length; so once what is left is no more than SETTLED rows in all, every
    mesh's share of it is passed through in order by one task.  The set is the same either way.
    Each round keeps at least the first of the rest; most_rounds only guards against running on for ever.
    """
    ranked = stored(placed(candidates, ["mesh_id"], list(_rank_columns()), "r"), "ranked")
    ends = ranked.select("mesh_id", "r", F.explode(F.array("hi", "lo")).alias("v"))
    near = ends.join(neighbours(edges), ["mesh_id", "v"]).select("mesh_id", "r", F.col("n").alias("v"))
    touched = ends.select("*", F.lit(True).alias("own")).union(near.select("*", F.lit(False).alias("own")))
    # the ends of a collapse are neighbours of each other, too: a vertex is either written or only read
    left = stored(touched.groupBy("mesh_id", "r", "v").agg(F.max("own").alias("own")), "left")
    kept: list[DataFrame] = []
    for done in itertools.count():
        rows = left.count()
        if rows <= SETTLED:
            kept.append(stored(left.groupBy("mesh_id").applyInPandas(_passed, "mesh_id string, r long"), "kept"))
            break
        if done >= most_rounds:
            raise RuntimeError(f"candidates are left after {most_rounds} rounds")
        first = left.where("own").groupBy("mesh_id", "v").agg(F.min("r").alias("first"))
        met = left.join(first, ["mesh_id", "v"])
        won = met.groupBy("mesh_id", "r").agg(F.min("first").alias("least")).where("least = r").select("mesh_id", F.col("r").alias("first"), F.lit(True).alias("won"))
        # who reads what a winner writes goes; only the first to write a vertex can have won
        gone = met.join(won, ["mesh_id", "first"]).groupBy("mesh_id", "r").agg(F.max(F.col("first") == F.col("r")).alias("won"))
        state = stored(left.join(gone, ["mesh_id", "r"], "left"), "state")
        kept.append(stored(state.where("won and own").select("mesh_id", "r").distinct(), "kept"))
        if len(kept) >= MERGE_EVERY:
            kept = [_merged(kept, ["mesh_id", "r"])]
        last, left = left, stored(state.where("won is null").drop("won"), "left")
        discard(last, state)
    chosen = _merged(kept, ["mesh_id", "r"])
    out = stored(ranked.join(chosen, ["mesh_id", "r"], "left_semi").select(candidates.columns), "greedy")
    discard(ranked, left, chosen)
    return out


def _passed(rows: pd.DataFrame) -> pd.DataFrame:
    """A greedy pass over what is left of a mesh: rows (mesh_id, r, v, own)."""
    rows = rows.sort_values("r", kind="stable")
    taken: set[int] = set()
    kept = []
    cuts = np.flatnonzero(np.append(True, np.diff(rows["r"].to_numpy()) != 0)) if len(rows) else []
    v, own, r = rows["v"].to_numpy(), rows["own"].to_numpy(), rows["r"].to_numpy()
    for i, j in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        if taken.isdisjoint(v[i:j].tolist()):
            kept.append(int(r[i]))
            taken.update(v[i:j][own[i:j]].tolist())
    return pd.DataFrame({"mesh_id": pd.Series([rows["mesh_id"].iloc[0]] * len(kept), dtype=object), "r": pd.Series(kept, dtype="int64")})


def _merged(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """These columns of several stored tables as one, and the tables go."""
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    out = stored(out.select(columns), "kept")
    discard(*tables)
    return out


def contract_faces(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Faces after the collapses: hi becomes lo, and faces left with fewer than three corners go."""
    moved = chosen.select("mesh_id", F.col("hi").alias("old"), F.col("lo").alias("new"))
    out = faces
    for k in ("v0", "v1", "v2"):
        out = out.join(moved.select("mesh_id", F.col("old").alias(k), F.col("new").alias(f"_{k}")), ["mesh_id", k], "left")
        out = out.withColumn(k, F.coalesce(f"_{k}", k)).drop(f"_{k}")
    out = out.where("v0 <> v1 and v1 <> v2 and v0 <> v2")
    v = M.least_first((F.col("v0"), F.col("v1"), F.col("v2")))
    return out.select("mesh_id", "fid", v[0].alias("v0"), v[1].alias("v1"), v[2].alias("v2"))


def contract_vertices(vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vertices after the collapses: hi is gone, lo stands at the best point (and has both quadrics, if any)."""
    left = vertices.join(chosen.select("mesh_id", F.col("hi").alias("vid")), ["mesh_id", "vid"], "left_anti")
    q = [c for c in vertices.columns if c.startswith("q_")]
    joined = left.join(chosen.select("mesh_id", F.col("lo").alias("vid"), "px", "py", "pz", F.col("hi").alias("_hi")), ["mesh_id", "vid"], "left")
    if q:
        gone = vertices.select("mesh_id", F.col("vid").alias("_hi"), *(F.col(c).alias(f"_{c}") for c in q))
        joined = joined.join(gone, ["mesh_id", "_hi"], "left")
    moved = [F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"), F.coalesce("pz", "z").alias("z")]
    return joined.select("mesh_id", "vid", *moved, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in q))
