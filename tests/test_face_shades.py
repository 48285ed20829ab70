"""Shades of faces as a table of their own, and as pixels show them."""

import numpy as np
import pytest
from test_surfaces import grid, surface

from facetflow.operators import raster


@pytest.mark.parametrize("projection", raster.PROJECTIONS)
def test_shades_are_those_of_the_normals_and_of_the_pixels(spark, projection):
    vertices, faces = grid(4, lambda i, j: ((i * 7 + j * 3) % 5) / 4)
    s = surface(spark, vertices, faces)
    bad = s.faces.selectExpr("mesh_id", "fid + 100 as fid", "v0", "v1", "cast(999 as long) as v2")
    found = {r["fid"]: r["color"] for r in raster.face_shades(s.faces.union(bad), s.vertices, projection).collect()}
    axis, p = {"xy": 2, "yz": 0, "xz": 1}[projection.removeprefix("-")], np.array(vertices)
    n = np.array([np.cross(p[b] - p[a], p[c] - p[a]) for a, b, c in faces])
    assert found == dict(enumerate(np.round(215 - 85 * np.abs(n[:, axis]) / np.linalg.norm(n, axis=1)).astype(int).tolist()))
    assert {r["color"] for r in raster.rasterize(s.vertices, s.faces, projection, 60, 60, 2).collect()} <= set(found.values())


def test_a_face_without_area_and_no_faces(spark):
    s = surface(spark, *grid(2))
    flat = s.faces.selectExpr("mesh_id", "fid", "v0", "v0 as v1", "v2")
    assert {r["color"] for r in raster.face_shades(flat, s.vertices, "xz").collect()} == {raster.SHADE}
    assert raster.face_shades(s.faces.limit(0), s.vertices, "xz").isEmpty()
