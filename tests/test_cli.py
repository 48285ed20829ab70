"""The command line, from files to files."""

import csv

import pytest
from test_surfaces import grid, surface

from facetflow import cli
from facetflow.operators import tables
from facetflow.sources import obj


@pytest.fixture
def mesh(spark, tmp_path):
    path = str(tmp_path / "bunny_r25_t1.obj")
    obj.write_obj_file(surface(spark, *grid(7, lambda i, j: ((i * 5 + j * 3) % 4) / 3)), path)
    return path


@pytest.mark.parametrize("mode", ["sequential", "partitioned_batch"])
def test_simplify_writes_mesh_and_statistics(spark, mesh, tmp_path, mode, capsys):
    out, stats = str(tmp_path / "out" / "a.obj"), str(tmp_path / "stats" / "s.csv")
    assert cli.main(["simplify", mesh, out, "80%", "--mode", mode, "--threads=2", "--stats-out", stats], spark) == 0
    left = obj.check(obj.read_obj(spark, out))
    assert left.vertices.count() == 40 and left.faces.count() == 72 - 2 * 9
    said = capsys.readouterr().out
    assert f"Mode: {mode}" in said and "final_vertex_count: 40" in said
    with open(stats, newline="") as f:
        lines = f.read().splitlines()
        rows = list(csv.DictReader(lines))
    assert lines[1] == f'metadata,"run","mode",,"{mode}"'
    names = [r["name"] for r in rows if r["kind"] == "metric" and r["scope"] == "summary"]
    assert len(names) == len(set(names)) == 21
    values = {r["name"]: r["numeric_value"] for r in rows if r["scope"] == "summary"}
    assert float(values["accepted_collapses"]) == 9 and float(values["target_vertex_count"]) == 40
    assert {r["name"] for r in rows if r["kind"] == "phase"} >= {"mesh_load_seconds", "mesh_write_seconds", "total_seconds", "initial_queue_build_seconds"}
    assert [r["text_value"] for r in rows if r["name"] == "input_path"] == [mesh]


def test_compare_report_and_render(spark, mesh, tmp_path, capsys):
    table = str(tmp_path / "q.csv")
    assert cli.main(["compare", mesh, mesh, "--width", "32", "--height", "32", "--padding", "2", "--output", table], spark) == 0
    lines = open(table).read().splitlines()
    assert lines[0] == "scope,name,value" and '"summary","flagged","false"' in lines and len(lines) == 15
    log = tmp_path / "sweep.txt"
    log.write_text("Running mesh=bunny target_vertices=25% threads=1\nSimplification time: 2.0 s\nRunning mesh=bunny target_vertices=25% threads=2\nSimplification time: 1.0 s\n")
    assert cli.main(["report", str(log)], spark) == 0
    assert "|2.0" in capsys.readouterr().out.replace(" ", "")
    picture = tmp_path / "p.pgm"
    assert cli.main(["render", mesh, str(picture), "--width", "40", "--height", "30", "--padding", "3"], spark) == 0
    raw = picture.read_bytes()
    assert raw.startswith(b"P5 40 30 255\n") and len(raw) == 13 + 1200 and len(set(raw[13:])) > 2
    assert cli.main(["render", mesh, str(picture), "--mesh", "dragon", "--width", "40", "--height", "30"], spark) == 0
    assert picture.read_bytes().startswith(b"P5 30 40 255\n")  # turned


@pytest.mark.parametrize("argv", [[], ["simplify", "a"], ["simplify", "a.obj", "b.obj", "120%"], ["simplify", "a.obj", "b.obj", "10%", "--threads", "0"], ["simplify", "a.obj", "b.obj", "10%", "--mode", "x"], ["simplify", "/none.obj", "b.obj", "10%"], ["simplify", "a.obj", "a.obj", "10%"], ["other"]])
def test_errors_are_one_line_and_exit_1(spark, argv, capsys):
    assert cli.main(argv, spark) == 1
    assert capsys.readouterr().err.startswith("error: ")


def test_a_bad_line_is_an_error(spark, tmp_path, capsys):
    (tmp_path / "bad.obj").write_text("v 0 0 0\nv 1 0\n")
    assert cli.main(["simplify", str(tmp_path / "bad.obj"), str(tmp_path / "o.obj"), "50%"], spark) == 1
    assert "error: " in capsys.readouterr().err


def test_csv_fields():
    assert [cli.quoted(v) for v in ('a"b', None, 3, 0.5, "")] == ['"a""b"', "", "3", "0.5", '""']


def test_scopes_delete_what_they_made(spark, tmp_path):
    import os

    where = str(tmp_path / "shared")
    spark.sparkContext._conf.set("spark.checkpoint.dir", where)
    old = tables.shared_dir
    try:
        tables.shared_dir = lambda s: where
        with tables.scope(spark) as keep:
            one = tables.stored(spark.range(10))
            two = keep(tables.stored(one.where("id > 5")))
            assert len(os.listdir(where)) == 2
            tables.discard(one)
            assert len(os.listdir(where)) == 1
        assert two.count() == 4 and len(os.listdir(where)) == 1
        with tables.scope(spark):
            assert obj.read_obj(spark, _small(tmp_path)).vertices.count() == 3
        assert len(os.listdir(where)) == 1
    finally:
        tables.shared_dir = old


def _small(tmp_path):
    path = tmp_path / "t.obj"
    path.write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    return str(path)


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name in ("a.obj", "b.obj"):
        (tmp_path / name).write_text("".join(f"# {name} {i}\r\n" for i in range(2000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = obj.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r["mesh_id"], r["line_no"], r["line"].strip()) for r in rows) == sorted((n, i, f"# {n}.obj {i}") for n in "ab" for i in range(2000))


def test_placed_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("k"), (F.col("id") * 7919 % 5000).alias("x"))
    for key in "ab":
        own = tables.placed(df, ["k"], [F.col("x")], "place").where(F.col("k") == key).orderBy("place").collect()
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and [r["x"] for r in own] == sorted(r["x"] for r in own)


def test_large_polygons_have_faces_of_their_own(spark):
    n = 1004
    text = [*(f"v {i} {i * i} 0" for i in range(n)), "f " + " ".join(str(i + 1) for i in range(n)), "f 1 2 3"]
    lines = spark.createDataFrame([("m", i, t) for i, t in enumerate(text)], "mesh_id string, line_no long, line string")
    ids = [r["fid"] for r in obj.parse(lines, "polygons").faces.collect()]
    assert sorted(ids) == list(range(n - 1))


def test_a_missing_quadric_is_an_error(spark):
    from facetflow.operators import quadrics, topology

    s = surface(spark, *grid(4))
    q = quadrics.vertex_quadrics(s.faces, s.vertices).where("vid <> 5")
    edges = topology.two_sided_edges(topology.half_edges(s.faces))
    with pytest.raises(Exception, match="no quadric"):
        quadrics.edge_candidates(edges, s.vertices, q).collect()
