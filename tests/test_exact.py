"""Sums and rings that don't depend on how rows are dealt."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_surfaces import OCTA, grid, surface

from facetflow.functions import vecmath as M
from facetflow.functions.exact import exact_sums
from facetflow.operators import quadrics, topology


def test_exact_sums_equal_fsum_for_any_partitions(spark):
    rng = random.Random(3)
    rows = []
    for key in range(40):
        top = rng.choice([-20, 0, 5, 20, 40, 70])
        values = [rng.uniform(-1, 1) * 2.0 ** rng.randint(top - 45, top) for _ in range(rng.randint(1, 60))]
        values += [-v for v in values[::2]]  # cancellation
        rows += [(key, v) for v in values]
    rows += [(100, 0.1)] * 10 + [(101, None), (102, 1e300), (102, 1e300), (103, float("nan")), (103, 1.0), (104, 1e16), (104, 1.0), (104, 1e-20), (105, -1e16), (105, -1.0), (105, -1e-20), (106, 2.0**-16), (106, -(2.0**-112))]
    expected = {}
    for key, v in rows:
        expected.setdefault(key, []).append(v)
    df = spark.createDataFrame(rows, "k int, v double")
    for n in (1, 8, 50):
        found = {r["k"]: r["v"] for r in exact_sums(df.repartition(n), ["k"], ["v"]).collect()}
        assert found.keys() == expected.keys()
        for key, values in expected.items():
            if key == 101:
                assert found[key] is None
            elif key == 103:
                assert math.isnan(found[key])
            else:
                assert found[key] == math.fsum(values), (key, n)


def test_quadrics_have_the_same_bits_for_any_partitions(spark):
    s = surface(spark, *grid(6, lambda i, j: ((i * 7 + j * 3) % 5) / 3))
    told = []
    for n in (1, 8, 60):
        told.append({tuple(r) for r in quadrics.vertex_quadrics(s.faces.repartition(n), s.vertices).collect()})
    assert told[0] == told[1] == told[2]
    planes = {k: [] for k in range(36)}
    for r in quadrics.face_planes(s.faces, s.vertices).collect():
        for v in ("v0", "v1", "v2"):
            planes[r[v]].append(r)
    for row in told[0]:
        assert row[-1] == math.fsum(r["d"] * r["d"] for r in planes[row[1]]) and row[2] == math.fsum(r["nx"] * r["nx"] for r in planes[row[1]])


def eliminated(m):
    """The least pivot, by a plain elimination."""
    m, found = [list(r) for r in m], []
    for k in range(3):
        best = max(range(k, 3), key=lambda r: (abs(m[r][k]), -r))
        found.append(abs(m[best][k]))
        if not found[-1]:
            return None
        m[k], m[best] = m[best], m[k]
        for r in range(k + 1, 3):
            factor = m[r][k] / m[k][k]
            m[r] = [x - factor * y for x, y in zip(m[r], m[k], strict=True)]
    return min(found)


def test_pivots_decide_where_the_determinant_passes(spark):
    rng = random.Random(4)
    cases = [[rng.uniform(-1, 1) for _ in range(10)] for _ in range(30)]
    cases += [[1e9, 0, 0, -1e9, 1e9, 0, -1e9, 1e-13, -1e-13, 1.0], [0, 0, 0, 0, 1.0, 0, 0, 1.0, 0, 0], [0, 2.0, 0, -2.0, 0, 0, -2.0, 3.0, -3.0, 1.0]]
    df = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(cases)], "id int, " + ", ".join(f"q_{k} double" for k in M.Q))
    q = M.quadric()
    ends = [tuple(F.lit(x) for x in p) for p in ((0.0, 0.0, 0.0), (4.0, 4.0, 4.0))]
    rows = df.select("id", M.least_pivot(M.upper(q)).alias("p"), M.solve(q)[0].alias("det"), *(c.alias(k) for c, k in zip(M.best_point(q, *ends), "xyz", strict=True))).orderBy("id").collect()
    for r, own in zip(rows, cases, strict=True):
        aa, ab, ac, _, bb, bc, _, cc, _, _ = own
        expected = eliminated([[aa, ab, ac], [ab, bb, bc], [ac, bc, cc]])
        assert (r["p"] is None) == (expected is None)
        assert expected is None or math.isclose(r["p"], expected, rel_tol=1e-6)
    assert abs(rows[30]["det"]) >= M.SINGULAR and (rows[30]["x"], rows[30]["y"], rows[30]["z"]) == (2.0, 2.0, 2.0)
    assert (rows[31]["x"], rows[32]["x"], rows[32]["y"], rows[32]["z"]) == (2.0, 1.0, 1.0, 1.0)


def walked(edges):
    """{(src, dst): least dst of a closed fan}, by walking spoke by spoke."""
    opp = {(s, d): o for s, d, o in edges}
    out = {}
    for s, d in opp:
        seen, at = [], d
        while at is not None and at not in seen:
            seen.append(at)
            at = opp.get((s, at))
        out[s, d] = min(seen) if at == d else None
    return out


def bow_tie():
    v, f = OCTA
    ids = [6, 0, 7, 8, 9, 10]  # vertex 0 of the first is vertex 1 of the second
    return v + [(x + 2, y, z) for i, (x, y, z) in enumerate(v) if i != 1], f + [tuple(ids[k] for k in t) for t in f]


@pytest.mark.parametrize("hub", [64, 3])
def test_rings_are_walks_around_fans(spark, hub):
    wheel = ([(0, 0, 0), *((math.cos(k), math.sin(k), 0) for k in range(20))], [(0, 1 + k, 1 + (k + 1) % 20) for k in range(20)])
    open_wheel = (wheel[0], wheel[1][:-1])
    tangled = (wheel[0], [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 2), (0, 5, 6)])  # a tail runs into a ring
    for v, f in (bow_tie(), wheel, open_wheel, tangled, grid(4)):
        edges = topology.half_edges(surface(spark, v, f).faces)
        expected = walked([(r["src"], r["dst"], r["opp"]) for r in edges.collect()])
        assert {(r["src"], r["dst"]): r["ring"] for r in topology.rings(edges, hub).collect()} == expected


def test_touching_fans_have_rings_of_their_own(spark):
    edges = topology.half_edges(surface(spark, *bow_tie()).faces)
    assert len({r["ring"] for r in topology.rings(edges).where("src = 0").collect()} - {None}) == 2
    found = {(r["hi"], r["lo"]) for r in topology.collapsible_edges(edges).collect()}
    assert len(found) == 24  # all edges of both


def test_a_hub_of_any_degree(spark):
    n = 5000
    faces = spark.range(n).selectExpr("'m' as mesh_id", "id as fid", "0L as v0", "id + 1 as v1", f"(id + 1) % {n} + 1 as v2")
    edges = topology.half_edges(faces)
    got = topology.rings(edges).where("src = 0").agg(F.count("*").alias("n"), F.count("ring").alias("on"), F.max("ring").alias("ring")).first()
    assert (got["n"], got["on"], got["ring"]) == (n, n, 1)
    assert [r["vid"] for r in topology.closed_vertices(edges).collect()] == [0]
    cut = topology.half_edges(faces.where("fid <> 77"))
    assert topology.rings(cut).where("ring is not null").isEmpty()
    assert topology.rings(edges.limit(0)).isEmpty()
