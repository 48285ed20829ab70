"""Components linked up by tasks in small blocks."""

import numpy as np
from test_surfaces import grid, surface

from facetflow.operators import graph, quality


def test_labels_are_least_numbers():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    expected = list(range(500))
    for _ in range(500):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            expected[x] = expected[y] = min(expected[x], expected[y])
    assert quality._labels(500, a, b).tolist() == expected


def test_components_take_few_steps(spark, monkeypatch):
    """Vertices were linked by rounds of joins, a row for each edge; now only what tasks share is."""
    linked = []
    monkeypatch.setattr(quality, "connected_components", lambda edges, store: linked.append(edges.count()) or graph.connected_components(edges, store))
    monkeypatch.setattr(quality, "FACES", 40)  # many blocks
    vertices, faces = grid(12)
    faces = [f for f in faces if all(v // 12 not in (5,) for v in f)]  # two islands
    found = {r["vid"]: r["component"] for r in quality.components(surface(spark, vertices, faces).faces).collect()}
    assert found == {v: 0 if v < 60 else 72 for v in range(144) if v // 12 != 5}
    assert linked[0] < len(faces)
