"""Pictures filled by tiles, against a plain pass over faces and pixels."""

import numpy as np
import pyarrow as pa
import pytest
from test_render import painted
from test_surfaces import grid, surface

from facetflow.operators import raster


def faces_of(rng, n, width, height):
    """A batch as the painter gets it, and its rows."""
    xy = rng.uniform(-0.2, 1.2, (n, 3, 2)) * (width, height)
    xy[::3] = np.round(xy[::3])  # edges through pixel corners
    xy[1::4] = xy[1::4].mean(axis=1, keepdims=True) + (xy[1::4] - xy[1::4].mean(axis=1, keepdims=True)) * 0.05
    depth = np.round(rng.uniform(0, 2, (n, 3)))
    depth[::2] = 1.0  # many ties
    (ax, ay), (bx, by), (cx, cy) = (xy[:, k].T for k in range(3))
    area = (cx - ax) * (by - ay) - (cy - ay) * (bx - ax)
    low = np.maximum(0, np.floor(xy.min(axis=1))).astype(np.int32)
    high = np.minimum((width - 1, height - 1), np.ceil(xy.max(axis=1))).astype(np.int32)
    columns = {"mesh_id": [f"m{k % 3}" for k in range(n)], "fid": rng.permutation(n).astype(np.int64)}
    for k, name in enumerate("abc"):
        columns |= {f"{name}x": xy[:, k, 0], f"{name}y": xy[:, k, 1], f"{name}d": depth[:, k]}
    columns |= {"area": area, "color": np.arange(n, dtype=np.int32), "x0": low[:, 0], "x1": high[:, 0], "y0": low[:, 1], "y1": high[:, 1]}
    keep = (np.abs(area) >= 1e-8) & (low <= high).all(axis=1)
    return pa.RecordBatch.from_pydict(columns).filter(pa.array(keep))


def plain(rows, width, height):
    best = {}
    for r in rows:
        for y in range(height):
            for x in range(width):
                u, v = x + 0.5, y + 0.5
                side = lambda a, b: ((u - r[f"{a}x"]) * (r[f"{b}y"] - r[f"{a}y"]) - (v - r[f"{a}y"]) * (r[f"{b}x"] - r[f"{a}x"])) / r["area"]  # noqa: B023, E731
                w = side("b", "c"), side("c", "a"), side("a", "b")
                if r["x0"] <= x <= r["x1"] and r["y0"] <= y <= r["y1"] and min(w) >= 0:
                    own = (round(w[0] * r["ad"] + w[1] * r["bd"] + w[2] * r["cd"], 9), -r["fid"], r["color"])
                    best[r["mesh_id"], x, y] = max(best.get((r["mesh_id"], x, y), own), own)
    return best


@pytest.mark.parametrize(("tile", "at_once", "held"), [(64, 1 << 20, 1 << 20), (7, 50, 1 << 20), (16, 300, 40)])
def test_tiles_shares_and_early_winners_change_nothing(tile, at_once, held):
    width, height = 37, 23
    batch = faces_of(np.random.default_rng(5), 60, width, height)
    parts = [batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]
    found = {}
    for out in raster._painter(width, height, tile, at_once, held)(iter(parts)):
        for r in out.to_pylist():
            key, own = (r["mesh_id"], r["px"], r["py"]), (r["depth"], -r["fid"], r["color"])
            found[key] = max(found.get(key, own), own)
    expected = plain(batch.to_pylist(), width, height)
    assert found.keys() == expected.keys() and len(found) > 1000
    assert all(abs(found[k][0] - e[0]) < 1e-8 and found[k][1:] == e[1:] for k, e in expected.items())


def test_a_task_sends_winners_not_covered_pixels():
    rows = faces_of(np.random.default_rng(6), 1, 30, 30).to_pylist()
    whole = rows[0] | {"ax": -100.0, "ay": -100.0, "bx": -100.0, "by": 300.0, "cx": 300.0, "cy": -100.0, "x0": 0, "x1": 29, "y0": 0, "y1": 29}
    whole["area"] = (whole["cx"] - whole["ax"]) * (whole["by"] - whole["ay"]) - (whole["cy"] - whole["ay"]) * (whole["bx"] - whole["ax"])
    batch = pa.RecordBatch.from_pylist([whole | {"fid": k, "ad": 1.0, "bd": 1.0, "cd": 1.0} for k in range(500)])
    out = list(raster._painter(30, 30, 8, 1000, 10_000)(iter([batch])))
    assert sum(b.num_rows for b in out) == 900 and {f for b in out for f in b.column("fid").to_pylist()} == {0}


def test_first_face_wins_where_tiles_meet(spark):
    """Two layers of one depth: the first is seen everywhere, whichever tile or task a pixel is in."""
    v, f = grid(4)
    s = surface(spark, v, f + f)
    found = {(r["px"], r["py"]): r["color"] for r in raster.rasterize(s.vertices, s.faces.repartition(7), "xy", 150, 150, 2).collect()}
    assert {k: c for k, (_, c) in painted(v, f, 150, 2).items()} == found


def test_missing_corners_and_empty_tables(spark):
    v, f = grid(3)
    s = surface(spark, v, f)
    bad = s.faces.selectExpr("mesh_id", "fid + 100 as fid", "v0", "v1", "cast(999 as long) as v2")
    none = s.faces.selectExpr("mesh_id", "fid + 200 as fid", "v0", "cast(null as long) as v1", "v2")
    whole = raster.rasterize(s.vertices, s.faces, "xy", 40, 40, 2).count()
    assert raster.rasterize(s.vertices, s.faces.union(bad).union(none), "xy", 40, 40, 2).count() == whole
    assert raster.rasterize(s.vertices.limit(0), s.faces.limit(0), "xy", 40, 40, 2).count() == 0
    assert raster.rasterize(s.vertices, s.faces.limit(0), "xy", 40, 40, 2).count() == 9
