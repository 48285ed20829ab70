"""Hand-made surfaces with known answers."""

import pytest
from pyspark.sql import functions as F

from facetflow.operators import quality, quadrics, raster, select, topology
from facetflow.operators.tables import numbered, running_sum
from facetflow.plans.options import SimplifyOptions, check_paths, parse_count, parse_fraction, target_count
from facetflow.plans.simplify import simplify
from facetflow.sources import obj
from facetflow.sources.surfaces import FACE_SCHEMA, VERTEX_SCHEMA, Surface, shell, turned

OCTA = ([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)])


def grid(n, z=lambda i, j: 0.0):
    v = [(float(i), float(j), z(i, j)) for j in range(n) for i in range(n)]
    f = []
    for j in range(n - 1):
        for i in range(n - 1):
            a = j * n + i
            f += [(a, a + 1, a + n + 1), (a, a + n + 1, a + n)]
    return v, f


def surface(spark, vertices, faces, name="m"):
    v = spark.createDataFrame([(name, i, *map(float, p)) for i, p in enumerate(vertices)], VERTEX_SCHEMA)
    return Surface(v, turned(spark.createDataFrame([(name, i, *f) for i, f in enumerate(faces)], FACE_SCHEMA)))


CASES = {
    "tri": ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)], 3, 1, 3, 0, 0),
    "tetra": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)], 4, 4, 6, 6, 6),
    "octa": (*OCTA, 6, 8, 12, 12, 12),
    "grid3": (*grid(3), 9, 8, 16, 8, 0),
    "grid4": (*grid(4), 16, 18, 33, 21, 5),
    "flat5": (*grid(5), 25, 32, 56, 40, 16),
    "fan3": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1)], [(0, 1, 2), (1, 0, 3), (0, 1, 4)], 5, 3, 7, 1, 0),
    "flipped": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0)], [(0, 1, 2), (0, 1, 3)], 4, 2, 5, 0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_counts(spark, name):
    vertices, faces, v, f, e, two, collapsible = CASES[name]
    s = surface(spark, vertices, faces)
    edges = topology.half_edges(s.faces)
    row = topology.euler_characteristic(s.vertices, s.faces).first()
    assert (row["v"], row["f"], row["e"]) == (v, f, e)
    assert topology.two_sided_edges(edges).count() == two
    assert topology.collapsible_edges(edges).count() == collapsible


def test_touching_fans_are_not_closed(spark):
    v, f = OCTA
    other = [(x + 2, y, z) for x, y, z in v]
    # vertex 0 of the first is vertex 1 of the second
    ids = [6, 0, 7, 8, 9, 10]
    s = surface(spark, v + [p for i, p in enumerate(other) if i != 1], f + [tuple(ids[k] for k in t) for t in f])
    closed = {r["vid"] for r in topology.closed_vertices(topology.half_edges(s.faces)).collect()}
    assert closed == set(range(1, 11))


def test_flat_grid_falls_back_to_midpoints(spark):
    s = surface(spark, *grid(5))
    edges = topology.half_edges(s.faces)
    rows = quadrics.edge_candidates(topology.two_sided_edges(edges), s.vertices, quadrics.vertex_quadrics(s.faces, s.vertices)).collect()
    place = {r["vid"]: (r["x"], r["y"]) for r in s.vertices.collect()}
    for r in rows:
        a, b = place[r["hi"]], place[r["lo"]]
        assert r["cost"] == 0 and (r["px"], r["py"]) == ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)


def test_greedy_batch_is_the_greedy_set(spark):
    s = surface(spark, *grid(9, lambda i, j: ((i * 7 + j * 3) % 5) / 3))
    edges = topology.half_edges(s.faces)
    priced = quadrics.edge_candidates(topology.collapsible_edges(edges), s.vertices, quadrics.vertex_quadrics(s.faces, s.vertices))
    near = {}
    for r in topology.neighbours(edges).collect():
        near.setdefault(r["v"], {r["v"]}).add(r["n"])
    kept = []
    for _, hi, lo in sorted((round(r["cost"], 6) + 0.0, r["hi"], r["lo"]) for r in priced.collect()):
        reads = near[hi] | near[lo]
        if all(not ({a, b} & reads) for a, b in kept):
            kept.append((hi, lo))
    assert {(r["hi"], r["lo"]) for r in select.greedy_batch(priced, edges).collect()} == set(kept)


@pytest.mark.parametrize("mode", ["partitioned_batch", "sequential"])
def test_simplify_keeps_the_surface_closed(spark, sf_dir, mode):
    s = shell(spark, sf_dir)
    n, f = s.vertices.count(), s.faces.count()
    done = simplify(s, SimplifyOptions(0.8, threads=4, mode=mode)).surface
    m = done.vertices.count()
    assert m == target_count(0.8, n)
    assert done.faces.count() == f - 2 * (n - m)
    assert topology.euler_characteristic(done.vertices, done.faces).first()["chi"] == 2
    assert topology.boundary_edges(topology.half_edges(done.faces)).isEmpty()
    sides = done.faces.select(F.explode(F.array(F.array("v0", "v1"), F.array("v1", "v2"), F.array("v2", "v0"))).alias("s"))
    assert sides.distinct().count() == sides.count()


def test_simplify_leaves_open_rims_and_needs_faces(spark):
    s = surface(spark, *grid(3))
    assert simplify(s, SimplifyOptions(0.5)).surface.vertices.count() == 9
    with pytest.raises(ValueError):
        simplify(Surface(s.vertices, s.faces.limit(0)), SimplifyOptions(0.5))


def test_components(spark):
    v, f = OCTA
    s = surface(spark, v * 2, f + [tuple(k + 6 for k in t) for t in f])
    assert quality.structural_stats(s.vertices, s.faces).first().asDict() == {"mesh_id": "m", "vertices": 12, "faces": 16, "degenerate_faces": 0, "components": 2}
    assert quality.structural_stats(s.vertices, s.faces.limit(0)).first()["components"] == 12


def lines(spark, text):
    return spark.createDataFrame([("m", i, x) for i, x in enumerate(text.split("\n"))], "mesh_id string, line_no long, line string")


V3 = "v 0 0 0\nv 1 0 0\nv 0 1 0\n"
GOOD = {
    "slash": (V3 + "f 1/1/1 2//2 3", [(0, 1, 2)]),
    "negative": (V3 + "f -3 -2 -1", [(0, 1, 2)]),
    "crlf": ("\t" + V3.replace("\n", "\r\n") + "f 1 2 3\r", [(0, 1, 2)]),
    "reversed": (V3 + "f 1 2 3\nf 1 3 2", [(0, 1, 2)]),
    "repeat": (V3 + "f 1 1 2", []),
    "collinear": ("v 0 0 0\nv 1 0 0\nv 2 0 0\nf 1 2 3", []),
    "junk": (V3 + "f 1x 2 3", [(0, 1, 2)]),
    "tags": ("# c\no x\nvn 0 0 1\n\n" + V3 + "s off\nf 3 1 2", [(0, 1, 2)]),
}
BAD = ["f 1 2 3\n" + V3, V3 + "f 0 1 2", V3 + "f 1 2 3 1", "v 0 0 0 1", "v 0 0 0 # c", "v 1d 0 0", V3 + "f +1 2 3", V3 + "f 1 2 4"]


@pytest.mark.parametrize("name", GOOD)
def test_strict_obj(spark, name):
    text, faces = GOOD[name]
    assert [(r["v0"], r["v1"], r["v2"]) for r in obj.parse(lines(spark, text)).faces.orderBy("fid").collect()] == faces


@pytest.mark.parametrize("text", BAD)
def test_strict_obj_errors(spark, text):
    s = obj.parse(lines(spark, text))
    with pytest.raises(Exception, match="expected|needs|triangular|range"):
        s.vertices.collect()
        s.faces.collect()


def test_other_dialects(spark):
    text = "v 0 0 0 1\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1 2 4 3\nf 1 2 9\nf 1 2 3"
    assert obj.parse(lines(spark, text), "permissive").faces.count() == 1
    assert [(r["v0"], r["v1"], r["v2"]) for r in obj.parse(lines(spark, text), "polygons").faces.orderBy("fid").collect()] == [(0, 1, 3), (0, 3, 2), (0, 1, 8), (0, 1, 2)]


def test_obj_files_round_trip(spark, tmp_path):
    s = surface(spark, *grid(4, lambda i, j: i / 3 + j / 7), name="a")
    obj.write_obj_file(s, str(tmp_path / "a.obj"))
    back = obj.check(obj.read_obj(spark, str(tmp_path / "a.obj")))
    key = lambda df: sorted(map(tuple, df.drop("fid").collect()))
    assert key(back.vertices) == key(s.vertices) and key(back.faces) == key(s.faces)
    with pytest.raises(ValueError):
        obj.check(Surface(s.vertices.where("vid > 3"), s.faces))


def test_discover_outputs(spark, tmp_path):
    for name in ("bunny_r0p5_t4.obj", "bunny_r25_t1.obj", "other.obj"):
        (tmp_path / name).write_text("v 0 0 0\n")
    found = obj.discover(spark, str(tmp_path))
    assert {(r["mesh"], r["target"], r["threads"]) for r in found.collect()} == {("bunny", "0.5", 4), ("bunny", "25", 1)}
    more = obj.add_originals(found, spark.createDataFrame([("bunny", "x"), ("dragon", "y")], "mesh string, path string"))
    assert {(r["mesh"], r["threads"]) for r in more.where("target = '100'").collect()} == {("bunny", 4), ("bunny", 1), ("dragon", 1)}


def test_render(spark):
    s = surface(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1)], [(0, 1, 2)])
    dots = raster.rasterize(s.vertices, s.faces.limit(0), "xy", 16, 16, 2).collect()
    assert {r["color"] for r in dots} == {raster.SPLAT} and len(dots) == 4
    lit = raster.rasterize(s.vertices, s.faces, "xy", 16, 16, 2)
    assert {r["color"] for r in lit.collect()} == {130}
    assert quality.render_disagreement(lit, lit, 16, 16).first()["differing"] == 0
    assert lit.isEmpty() is False and raster.turned_left(raster.turned_left(raster.turned_left(raster.turned_left(lit, 16), 16), 16), 16).exceptAll(lit).isEmpty()


def test_running_numbers(spark):
    df = spark.range(0, 300_000, 3).select(F.lit("m").alias("k"), F.col("id").alias("at"))
    assert numbered(df, ["k"], "at", "n").where("n * 3 <> at").isEmpty()
    assert running_sum(df, ["k"], "at", F.lit(2), "s").where("s <> (at / 3 + 1) * 2").isEmpty()


def test_options(tmp_path):
    assert [parse_fraction(x) for x in ("25%", "25", "0.25", "1", "0.5%", "1%")] == [0.25, 0.25, 0.25, 1.0, 0.005, 0.01]
    for bad in ("x", "-1", "101", "120%", "nan"):
        with pytest.raises(ValueError):
            parse_fraction(bad)
    for bad in ("0", "-1", "x", ""):
        with pytest.raises(ValueError):
            parse_count(bad)
    with pytest.raises(ValueError):
        SimplifyOptions(float("nan"))
    (tmp_path / "a").write_text("")
    with pytest.raises(ValueError):
        check_paths(str(tmp_path / "a"), str(tmp_path / "." / "a"))
    assert target_count(0.0, 10) == 1 and target_count(0.25, 10) == 3
