"""Half-edge topology as joins.

half_edges(mesh_id, src, dst, opp, fid): the directed edge src -> dst of face fid, opposite its third
corner.  The next half-edge is dst -> opp, the flip is dst -> src.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators.tables import discard, stored

#: Spokes of a vertex that one row may hold.
HUB = 64


def half_edges(faces: DataFrame) -> DataFrame:
    """Three directed edges a face.  Where faces claim the same one, the last face has it."""
    sides = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(c).alias("opp")) for a, b, c in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))))
    every = faces.select("mesh_id", "fid", F.inline(sides))
    last = F.max(F.struct("fid", "opp")).alias("o")
    return every.groupBy("mesh_id", "src", "dst").agg(last).select("mesh_id", "src", "dst", F.col("o.opp").alias("opp"), F.col("o.fid").alias("fid"))


def _flips(edges: DataFrame) -> DataFrame:
    return edges.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("opp").alias("other"))


def two_sided_edges(edges: DataFrame) -> DataFrame:
    """(mesh_id, hi, lo, o1, o0): each edge with faces on both sides once, by its larger and smaller end.

    o1 is opposite hi -> lo, o0 opposite lo -> hi.
    """
    down, up = edges.where("src > dst"), _flips(edges.where("src < dst"))
    return down.join(up, ["mesh_id", "src", "dst"]).select("mesh_id", F.col("src").alias("hi"), F.col("dst").alias("lo"), F.col("opp").alias("o1"), F.col("other").alias("o0"))


def boundary_edges(edges: DataFrame) -> DataFrame:
    """Half-edges without a flip."""
    return edges.join(_flips(edges).select("mesh_id", "src", "dst"), ["mesh_id", "src", "dst"], "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    """(mesh_id, v, n), either way round."""
    both = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("v"), F.col("src").alias("n")))
    return edges.select("mesh_id", F.inline(both)).distinct()


def _rings_in_rows(edges: DataFrame) -> DataFrame:
    """Rings of vertices with up to HUB spokes: a row holds a vertex, steps are doubled within it."""
    spokes = edges.groupBy("mesh_id", "src").agg(F.array_sort(F.collect_list(F.struct("dst", "opp"))).alias("s")).withColumn("dsts", F.col("s.dst"))
    at = F.transform("s", lambda e: (F.nullif(F.array_position("dsts", e["opp"]), F.lit(0)) - 1).cast("int"))
    places = spokes.select("mesh_id", "src", "dsts", at.alias("at"), F.sequence(F.lit(0), F.size("s") - 1).alias("ids"))
    jump = F.aggregate(
        F.sequence(F.lit(1), F.lit(HUB.bit_length() - 1)),
        F.struct(F.col("at"), F.col("ids").alias("least")),
        lambda state, k: F.struct(
            F.transform(F.col("ids"), lambda i: F.get(state["at"], F.get(state["at"], i))).alias("at"),
            F.transform(F.col("ids"), lambda i: F.least(F.get(state["least"], i), F.get(state["least"], F.get(state["at"], i)))).alias("least"),
        ),
    )
    walked = places.select("mesh_id", "src", "dsts", "ids", jump.alias("j"))
    ring = F.transform("ids", lambda i: F.struct(F.get("dsts", i).alias("dst"), F.when(F.array_contains("j.at", i), F.get("dsts", F.get("j.least", i))).alias("ring")))
    return walked.select("mesh_id", "src", F.inline(ring))


def _rings_by_joins(edges: DataFrame, most: int) -> DataFrame:
    """Rings of vertices with any number of spokes, up to most: a row is a spoke, steps are doubled by joins."""
    keys = ["mesh_id", "src", "at"]
    state = stored(edges.select("mesh_id", "src", "dst", F.col("opp").alias("at"), F.col("dst").alias("least")), "spokes")
    for _ in range((most - 1).bit_length()):
        onward = state.select("mesh_id", "src", F.col("dst").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        last, state = state, stored(state.join(onward, keys, "left").select("mesh_id", "src", "dst", F.col("_at").alias("at"), F.least("least", "_least").alias("least")), "spokes")
        discard(last)
    reached = state.select("mesh_id", "src", F.col("at").alias("dst"), F.lit(True).alias("_on")).distinct()
    return state.join(reached, ["mesh_id", "src", "dst"], "left").select("mesh_id", "src", "dst", F.when(F.col("_on"), F.col("least")).alias("ring"))


def rings(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(mesh_id, src, dst, ring): every spoke of src with the least dst of its fan if the fan is closed, else null.

    The next spoke after src -> dst is src -> opp.  Doubling steps (pointer jumping) finds in a few rounds
    where each spoke is after as many steps as its vertex has spokes: nowhere in an open fan, and in closed ones the
    spokes reached are just those of the rings.  Vertices above hub spokes are walked spoke by spoke with joins,
    so no row and no task holds one; the driver gets their largest number of spokes.  An empty table has no rings.
    """
    if hub > HUB:
        raise ValueError(f"a row holds {HUB} spokes at most")
    counts = edges.groupBy("mesh_id", "src").agg(F.count("*").alias("n")).where(F.col("n") > hub)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return _rings_in_rows(edges)
    hubs = stored(counts.select("mesh_id", "src"), "hubs")
    few = _rings_in_rows(edges.join(hubs, ["mesh_id", "src"], "left_anti"))
    return few.unionByName(_rings_by_joins(edges.join(hubs, ["mesh_id", "src"], "left_semi"), most))


def closed_vertices(edges: DataFrame) -> DataFrame:
    """(mesh_id, vid) of vertices whose faces form one cycle.  (Where two fans touch there are two, and the
    vertex isn't closed, though both of its rings may be.)"""
    one = (F.count("*") == F.count("ring")) & (F.min("ring") == F.max("ring"))
    return rings(edges).groupBy("mesh_id", F.col("src").alias("vid")).agg(one.alias("one")).where("one").select("mesh_id", "vid")


def link_violations(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(mesh_id, hi, lo) of edges whose ends share a neighbour besides the two opposite corners."""
    near = neighbours(edges)
    shared = (
        candidates.select("mesh_id", "hi", "lo", "o1", "o0")
        .join(near.select("mesh_id", F.col("v").alias("hi"), "n"), ["mesh_id", "hi"])
        .where("n <> o1 and n <> o0 and n <> lo")
        .join(near.select("mesh_id", F.col("v").alias("lo"), "n"), ["mesh_id", "lo", "n"], "left_semi")
    )
    return shared.select("mesh_id", "hi", "lo").distinct()


def collapsible_edges(edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates (two-sided edges by default) that keep the surface sound: closed rings around both ends, link
    condition.  Of a vertex where fans touch only the edge's own fan counts."""
    candidates = two_sided_edges(edges) if candidates is None else candidates
    closed = stored(rings(edges).where("ring is not null").select("mesh_id", "src", "dst"), "closed")  # used for both ends
    for src, dst in (("hi", "lo"), ("lo", "hi")):
        candidates = candidates.join(closed.select("mesh_id", F.col("src").alias(src), F.col("dst").alias(dst)), ["mesh_id", "hi", "lo"], "left_semi")
    candidates = stored(candidates, "in-rings")
    return candidates.join(link_violations(candidates, edges), ["mesh_id", "hi", "lo"], "left_anti")


def conflict_sets(candidates: DataFrame) -> DataFrame:
    """(mesh_id, hi, lo, claim): the sorted different corners that a collapse touches."""
    claim = F.array_sort(F.array_distinct(F.array("hi", "lo", "o1", "o0")))
    return candidates.select("mesh_id", "hi", "lo", claim.alias("claim"))


def euler_characteristic(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, v, e, f, chi)."""
    sides = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    e = faces.select("mesh_id", F.inline(sides)).distinct().groupBy("mesh_id").agg(F.count("*").alias("e"))
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("f"))
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    joined = v.join(e, "mesh_id", "left").join(f, "mesh_id", "left").select("mesh_id", "v", F.coalesce("e", zero).alias("e"), F.coalesce("f", zero).alias("f"))
    return joined.withColumn("chi", F.col("v") - F.col("e") + F.col("f"))
