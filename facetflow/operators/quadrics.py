"""Quadric error metrics: a partial and final sum, and prices of edges by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions import vecmath as M
from facetflow.functions.exact import exact_sums


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the positions of their corners: ax .. cz."""
    out = faces
    for v, p in (("v0", "a"), ("v1", "b"), ("v2", "c")):
        own = vertices.select("mesh_id", F.col("vid").alias(v), *(F.col(k).alias(p + k) for k in "xyz"))
        out = out.join(own, ["mesh_id", v])
    return out


def face_planes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, fid, v0, v1, v2, nx, ny, nz, d, area)."""
    n, d, area = M.plane(M.vec("a"), M.vec("b"), M.vec("c"))
    return corners(faces, vertices).select("mesh_id", "fid", "v0", "v1", "v2", n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"), d.alias("d"), area.alias("area"))


def vertex_quadrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, q_aa .. q_dd): sums over the planes of a vertex's faces, zeros for unused ones.

    The sums are exact, so they have the same bits whatever the order and the number of partitions.
    """
    planes = face_planes(faces, vertices)
    products = M.outer([F.col(c) for c in ("nx", "ny", "nz", "d")])
    spread = planes.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *(p.alias(f"q_{k}") for p, k in zip(products, M.Q, strict=True)))
    sums = exact_sums(spread, ["mesh_id", "vid"], [f"q_{k}" for k in M.Q])
    return vertices.select("mesh_id", "vid").join(sums, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.coalesce(f"q_{k}", F.lit(0.0)).alias(f"q_{k}") for k in M.Q))


def edge_candidates(edges: DataFrame, vertices: DataFrame, quadrics: DataFrame) -> DataFrame:
    """edges(mesh_id, hi, lo, ...) with the best point px, py, pz of each and its cost.

    An end without a place or a quadric is an error when the cost is used.
    """
    known = vertices.join(quadrics, ["mesh_id", "vid"])

    def side(end: str, prefix: str) -> DataFrame:
        columns = [*"xyz", *(f"q_{k}" for k in M.Q)]
        return known.select("mesh_id", F.col("vid").alias(end), *(F.col(c).alias(prefix + c) for c in columns))

    q = M.add_quadrics(M.quadric("a_q_"), M.quadric("b_q_"))
    joined = edges.join(side("hi", "a_"), ["mesh_id", "hi"], "left").join(side("lo", "b_"), ["mesh_id", "lo"], "left")
    p = M.best_point(q, M.vec("a_"), M.vec("b_"))
    priced = joined.withColumns({"px": p[0], "py": p[1], "pz": p[2]})
    cost = M.quadric_error(q, (F.col("px"), F.col("py"), F.col("pz")))
    lost = F.col("a_q_aa").isNull() | F.col("b_q_aa").isNull()
    message = F.concat(F.lit("no quadric for an end of edge "), F.col("hi").cast("string"), F.lit(", "), F.col("lo").cast("string"))
    return priced.select(*edges.columns, "px", "py", "pz", F.when(lost, F.raise_error(message)).otherwise(cost).alias("cost"))


def rank_of() -> Column:
    """The total order of collapses: rounded cost, then the ends."""
    return F.struct(M.tidy(F.col("cost")).alias("cost"), F.col("hi"), F.col("lo"))


def cheapest(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.orderBy(M.tidy(F.col("cost")), "hi", "lo").limit(k)
