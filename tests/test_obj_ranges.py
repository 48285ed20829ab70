"""OBJ files read by ranges of bytes against the same files read line by line."""

import pytest
from test_sink import awkward
from test_surfaces import surface

from facetflow.sources import obj, obj_ranges

STRICT = "# made by hand\nv 0 0 0\n  v\t1 0 0\r\nvn 0 0 1\n\nv 1e0 1 .5\nf 1 2 3\nf 3/1/1 1//2 -2\n# ä\nv 0 1 -0.25\nf 1 3 4\nf -4 -4 -1\nf 1 3/7 -1"
LOOSE = "v 0 0 0 9 9\nv 1 0\nv 1 0 0\nv 1 1 0\n v 5 5 5\nf 1 2 3\nf 1 2\nv 0 1 0\nf 1 2 3 4\nf 1 2 9\nv\t1 2 3\nf -1 -2 -3\nf\nf x y z\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode, text", [("strict", STRICT), ("permissive", LOOSE), ("polygons", LOOSE)])
@pytest.mark.parametrize("size", [17, 1 << 20])
def test_ranges_of_any_size_give_what_lines_give(spark, tmp_path, mode, text, size):
    (tmp_path / "a.obj").write_text(text)
    (tmp_path / "none.obj").write_text("")
    (tmp_path / "notes.txt").write_text("f 1 2 3")
    expected = obj.read_obj(spark, str(tmp_path / "a.obj"), mode)
    found = obj_ranges.read(spark, str(tmp_path), mode, size)
    assert rows(found.vertices) == rows(expected.vertices)
    assert rows(found.faces) == rows(expected.faces)


@pytest.mark.parametrize("piece", [1, 16, 1000])
def test_lines_are_cut_nowhere(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(obj_ranges, "PIECE", piece)
    data = b"a\n\n" + b"long" * 50 + b"\nlast\n\nopen"
    path = tmp_path / "x"
    path.write_bytes(data)
    system, where = obj_ranges.file_system(f"file:{path}")
    for size in (1, 2, 3, 10, 64, 1000):
        with system.open_input_file(where) as file:
            found = [b"".join(obj_ranges.pieces(file, k, min(k + size, len(data)))) for k in range(0, len(data), size)]
        assert b"".join(found) == data
        assert all(not own or own.endswith(b"\n") or own.endswith(b"open") for own in found)


def test_parts_of_a_mesh_are_read_in_their_order(spark, tmp_path):
    v, f = awkward(7)
    whole = surface(spark, v, f, name="a mesh")
    obj.write_obj(whole, str(tmp_path / "out"))
    found = obj_ranges.read(spark, str(tmp_path / "out"), range_bytes=50, parts=True)
    # zeros of either sign are equal
    assert rows(found.vertices) == sorted(("a mesh", i, *map(float, p)) for i, p in enumerate(v))
    assert {r[2:] for r in rows(found.faces)} == {r[2:] for r in rows(whole.faces)}


def test_errors(spark, tmp_path):
    path = tmp_path / "bad.obj"
    path.write_text("v 0 0 0\nv 0 0 x\nf 1 2 3\n")
    with pytest.raises(Exception, match="expected a floating-point number"):
        obj_ranges.read(spark, str(path), range_bytes=5).vertices.collect()
    path.write_text("v 0 0 0\nv 0 0 1\nf 1 2 3\n")
    with pytest.raises(Exception, match="face index out of range"):
        obj_ranges.read(spark, str(path), range_bytes=5).faces.collect()
    with pytest.raises(Exception, match="missing"):
        obj_ranges.read(spark, str(tmp_path / "missing.obj"))
    with pytest.raises(ValueError):
        obj_ranges.read(spark, str(path), "other")


def test_a_reader_of_vertices_gets_no_faces(spark, tmp_path):
    (tmp_path / "a.obj").write_text(STRICT)
    spark.dataSource.register(obj_ranges.ObjSource)
    found = spark.read.format("obj").options(rows="v", range_bytes=20).load(str(tmp_path / "a.obj"))
    assert [r["line"].split()[0] for r in found.collect()] == ["v"] * 4
