"""The verdict's text and places are those of its SQL."""

import duckdb
from test_surfaces import grid, surface

from facetflow.operators import quality
from facetflow.plans import queries as Q


def test_small_fractions_are_written_as_sql_writes_them(spark):
    """A cast wrote 4.7E-4; SQL writes 0.00047, and 1e-05 below 0.0001."""
    vertices, faces = grid(5, lambda i, j: ((i * 7 + j * 3) % 5) / 4)
    moved = [(x, y, z + 2 * (k == 12)) for k, (x, y, z) in enumerate(vertices)]
    a, b = (surface(spark, v, faces) for v in (vertices, moved))
    found = quality.verdict((a.vertices, a.faces), (b.vertices, b.faces), 512, 512).where("scope = 'render_diff' or name = 'average_render_diff'").collect()
    assert len(found) == 4
    values = spark.createDataFrame([(k / 512**2,) for k in (0, 1, 2, 27, 124, 262_144)], "v double").select(quality._digits("v").alias("t"), "v").collect()
    for text, number in [*((r["value"], float(r["value"])) for r in found), *((r["t"], r["v"]) for r in values)]:
        assert text == duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) AS VARCHAR)", [number]).fetchone()[0]


def test_verdict_compares_places_that_are_not_rounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q.quality, "verdict", lambda before, after: after[0])
    assert any(abs(r[k] - round(r[k], 6)) > 1e-12 for r in Q.quality_verdict(spark, sf_dir).collect() for k in "xyz")
