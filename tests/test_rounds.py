"""Rounds run to their end, however long chains of ties are."""

import pytest
from test_surfaces import grid, surface

from facetflow.operators import select
from facetflow.operators.tables import stored
from facetflow.plans import simplify as S
from facetflow.plans.options import SimplifyOptions


def chained(spark, w):
    """Edges (hi, lo) of a flat grid's inner vertices, all at cost 0, and its half edges."""
    from facetflow.operators import topology

    s = surface(spark, *grid(w))
    edges = stored(topology.half_edges(s.faces), "edges")
    return stored(topology.collapsible_edges(edges).selectExpr("*", "0.0 as cost"), "priced"), edges


@pytest.mark.parametrize(("w", "settled"), [(30, 200_000), (12, 0), (14, 500)])
def test_greedy_batch_goes_on_to_the_fixpoint(spark, monkeypatch, w, settled):
    """In one task at the end, in rounds to the end, or first in rounds and then in a task."""
    from facetflow.operators import topology

    monkeypatch.setattr(select, "SETTLED", settled)
    priced, edges = chained(spark, w)
    near = {}
    for r in topology.neighbours(edges).collect():
        near.setdefault(r["v"], {r["v"]}).add(r["n"])
    kept, written = set(), set()
    for hi, lo in sorted((r["hi"], r["lo"]) for r in priced.collect()):
        if not written & (near[hi] | near[lo]):
            kept.add((hi, lo))
            written |= {hi, lo}
    assert {(r["hi"], r["lo"]) for r in select.greedy_batch(priced, edges).collect()} == kept


def test_running_out_of_rounds_is_an_error(spark, monkeypatch):
    priced, edges = chained(spark, 8)
    monkeypatch.setattr(select, "SETTLED", 0)
    with pytest.raises(RuntimeError, match="rounds"):
        select.greedy_batch(priced, edges, 1)
    monkeypatch.setattr(S, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="above the goal"):
        S.simplify(surface(spark, *grid(8)), SimplifyOptions(0.4))
