"""OBJ text written side by side."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_surfaces import grid, surface

from facetflow.sources import obj
from facetflow.sources.surfaces import FACE_SCHEMA, VERTEX_SCHEMA, Surface


@pytest.fixture
def many_ranges(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "13"), strict=True):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


def text_of(vertices, faces):
    lines = ["v " + " ".join(f"{float(x):.17g}" for x in p) for p in vertices]
    turned = sorted(f[f.index(min(f)) :] + f[: f.index(min(f))] for f in faces)
    return "".join(f"{line}\n" for line in lines + ["f " + " ".join(str(k + 1) for k in f) for f in turned])


def awkward(n):
    rng = random.Random(9)
    v, f = grid(n)
    special = [0.1, 1 / 3, -0.0, 1e-5, 123456789.125, 1e17, 1e16, 5e-324, 1.7976931348623157e308, 100.0, -1e-300]
    return [(x + rng.random(), math.pi * y, special[i % len(special)]) for i, (x, y, _) in enumerate(v)], f


def test_a_file_has_the_bytes_of_a_plain_writer(spark, tmp_path, many_ranges):
    v, f = awkward(9)
    path = tmp_path / "new" / "a.obj"
    obj.write_obj_file(surface(spark, v, f), str(path))
    assert path.read_bytes().decode() == text_of(v, f)
    assert [p.name for p in path.parent.iterdir()] == ["a.obj"]  # nothing is left beside it
    back = obj.read_obj(spark, str(path))
    assert sorted((r["x"], r["y"], r["z"]) for r in back.vertices.collect()) == sorted(tuple(map(float, p)) for p in v)


def test_parts_of_each_mesh_are_its_sections(spark, tmp_path, many_ranges):
    meshes = {"one": awkward(8), "two": awkward(5)}
    both = [surface(spark, *m, name=name) for name, m in meshes.items()]
    whole = Surface(both[0].vertices.union(both[1].vertices), both[0].faces.union(both[1].faces))
    obj.write_obj(whole, str(tmp_path / "out"))
    for name, (v, f) in meshes.items():
        folder = str(tmp_path / "out" / f"mesh_id={name}")
        parts = obj.parts_of(spark, folder)
        assert len(parts) > 2
        obj.joined_file(spark, folder, str(tmp_path / f"{name}.obj"))
        assert (tmp_path / f"{name}.obj").read_text() == text_of(v, f)


def test_gaps_empty_surfaces_and_bad_paths(spark, tmp_path):
    v, f = grid(3)
    s = surface(spark, v, f)
    gone = Surface(s.vertices.where("vid <> 4"), s.faces)
    obj.write_obj_file(gone, str(tmp_path / "gone.obj"))
    kept = [t for t in f if 4 not in t]
    ids = {k: i for i, k in enumerate(k for k in range(9) if k != 4)}
    assert (tmp_path / "gone.obj").read_text() == text_of([p for k, p in enumerate(v) if k != 4], [tuple(ids[k] for k in t) for t in kept])
    none = Surface(spark.createDataFrame([], VERTEX_SCHEMA), spark.createDataFrame([], FACE_SCHEMA))
    obj.write_obj_file(none, str(tmp_path / "none.obj"))
    assert (tmp_path / "none.obj").read_bytes() == b""
    with pytest.raises(OSError):
        obj.write_obj_file(s, str(tmp_path))
    with pytest.raises(ValueError):
        obj.export_lines(s, 5)
    assert obj.export_lines(s).where(F.col("line") == "v 1.0 0.0 0.0").count() == 1
