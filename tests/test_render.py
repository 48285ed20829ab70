"""Renders at full size, against plain numpy."""

import numpy as np
from test_surfaces import grid, surface

from facetflow.operators import quality, raster, select
from facetflow.plans import queries as Q
from facetflow.sources.surfaces import terrain


def painted(vertices, faces, side, padding):
    """{(px, py): (depth, color)} of the xy view, every face against every pixel."""
    p = np.array(vertices, float)
    span = np.maximum(np.ptp(p[:, :2], axis=0), 1e-12)
    k = min((side - 2 * padding) / span)
    x = (side - span[0] * k) / 2 + (p[:, 0] - p[:, 0].min()) * k
    y = side - ((side - span[1] * k) / 2 + (p[:, 1] - p[:, 1].min()) * k)
    j, i = np.mgrid[0:side, 0:side] + 0.5
    best, color = np.full((side, side), -np.inf), np.full((side, side), raster.BLANK)
    for own in faces:
        own = own[own.index(min(own)) :] + own[: own.index(min(own))]
        n = np.cross(p[own[1]] - p[own[0]], p[own[2]] - p[own[0]])
        edge = lambda a, b, u, v: (u - x[a]) * (y[b] - y[a]) - (v - y[a]) * (x[b] - x[a])
        a, b, c = own
        area = edge(a, b, x[c], y[c])
        w = [edge(b, c, i, j) / area, edge(c, a, i, j) / area, edge(a, b, i, j) / area]
        depth = np.round(sum(q * p[v, 2] for q, v in zip(w, own, strict=True)), 9)
        new = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0) & (depth > best)
        best[new], color[new] = depth[new], int(np.round(215 - 85 * abs(n[2] / np.sqrt(n @ n))))
    return {(int(u), int(v)): (best[v, u], int(color[v, u])) for v, u in np.argwhere(best > -np.inf)}


def test_rasterize_at_its_own_size(spark):
    vertices, faces = grid(5, lambda i, j: ((i * 7 + j * 3) % 5) / 4)
    s = surface(spark, vertices, faces)
    found = {(r["px"], r["py"]): (r["depth"], r["color"]) for r in raster.rasterize(s.vertices, s.faces, "xy").collect()}
    expected = painted(vertices, faces, 512, 24)
    assert found.keys() == expected.keys() and len(found) > 200_000
    assert all(abs(found[k][0] - d) < 1e-6 and found[k][1] == c for k, (d, c) in expected.items())


def test_queries_show_every_face(spark, sf_dir):
    """At 48 x 48 this terrain's picture had at most 40 x 40 pixels."""
    assert Q.raster_zbuffer_full(spark, sf_dir).count() > 200_000
    assert Q.raster_turned_full(spark, sf_dir).count() > 200_000
    r = Q.render_disagreement_full(spark, sf_dir).first()
    assert r["differing"] > 40 * 40 and abs(r["fraction"] - r["differing"] / 512**2) < 1e-6


def test_verdict_renders_at_full_size(spark, sf_dir):
    t = terrain(spark, sf_dir)
    chosen = Q.stored(Q.independent_batch(spark, sf_dir).selectExpr("'terrain' as mesh_id", "*"), "chosen")
    after = select.contract_vertices(t.vertices, chosen), select.contract_faces(t.faces, chosen)
    pair = [raster.rasterize(v, f, "xy", 512, 512, 24) for v, f in ((t.vertices, t.faces), after)]
    expected = quality.render_disagreement(*pair, 512, 512).first()["fraction"]
    found = {(r["scope"], r["name"]): r["value"] for r in Q.quality_verdict(spark, sf_dir).collect()}
    assert float(found["render_diff", "xy"]) == expected
