"""Regions against the plain definitions: the least sound edge again and again, and one batch in order."""

import math

import pytest
from test_surfaces import grid, surface

from facetflow.operators.patch import price, solve
from facetflow.plans import simplify as S
from facetflow.plans.options import SimplifyOptions
from facetflow.plans.queries import shell, terrain


class Plain:
    """A mesh as sets, without any bookkeeping."""

    def __init__(self, vertices, faces):
        self.at = {r["vid"]: (r["x"], r["y"], r["z"]) for r in vertices}
        self.q = {r["vid"]: [r[c] for c in S._Q] for r in vertices}
        self.pri = {r["vid"]: r["pri"] for r in vertices}
        self.slab = {r["vid"]: r["place"] for r in vertices}
        self.faces = {r["fid"]: (r["v0"], r["v1"], r["v2"]) for r in faces}

    def of(self, v):
        return {f for f, own in self.faces.items() if v in own}

    def near(self, v):
        return {w for f in self.of(v) for w in self.faces[f]} - {v}

    def edges(self):
        return {(max(a, b, key=lambda v: (self.pri[v], v)), min(a, b, key=lambda v: (self.pri[v], v))) for own in self.faces.values() for a, b in zip(own, own[1:] + own[:1], strict=True)}

    def cost(self, a, b):
        return price([x + y for x, y in zip(self.q[a], self.q[b], strict=True)], self.at[a], self.at[b])

    def rank(self, e):
        return self.cost(*e)[0], self.pri[e[0]], self.pri[e[1]], *e

    def closed(self, v):
        """The sides opposite v form one cycle."""
        out = {}
        for f in self.of(v):
            k = self.faces[f].index(v)
            a, b = self.faces[f][k - 2], self.faces[f][k - 1]
            if a in out:
                return False
            out[a] = b
        seen, at = [], next(iter(out), None)
        while at is not None and at not in seen:
            seen.append(at)
            at = out.get(at)
        return at is not None and at == seen[0] and len(seen) == len(out)

    def opposite(self, a, b):
        return {w for f in self.of(a) & self.of(b) for w in self.faces[f]} - {a, b}

    def sound(self, a, b):
        return a in self.at and b in self.at and len(self.of(a) & self.of(b)) == 2 and self.near(a) & self.near(b) == self.opposite(a, b) and self.closed(a) and self.closed(b)

    def collapse(self, a, b):
        self.at[a] = self.cost(a, b)[2]
        self.q[a] = [x + y for x, y in zip(self.q[a], self.q.pop(b), strict=True)]
        del self.at[b]
        for f in self.of(b):
            own = tuple(a if v == b else v for v in self.faces[f])
            if len(set(own)) < 3:
                del self.faces[f]
            else:
                self.faces[f] = own

    def state(self):
        turn = lambda own: own[own.index(min(own)) :] + own[: own.index(min(own))]
        return {v: tuple(round(x, 9) for x in p) for v, p in self.at.items()}, {f: turn(own) for f, own in self.faces.items()}


def found(work):
    return {r["vid"]: tuple(round(r[c], 9) for c in "xyz") for r in work.vertices.collect()}, {r["fid"]: (r["v0"], r["v1"], r["v2"]) for r in work.faces.collect()}


def bumpy(spark, w):
    return surface(spark, *grid(w, lambda i, j: round(math.sin(i * 1.3) * math.cos(j * 0.7), 3)), name="bumpy")


SURFACES = {"terrain": lambda s: terrain(s, "/root/testdata/sf0.001"), "shell": lambda s: shell(s, "/root/testdata/sf0.001"), "flat": lambda s: surface(s, *grid(11)), "bumpy": lambda s: bumpy(s, 12)}


@pytest.mark.parametrize(("name", "most", "fraction"), [("terrain", 20_000, 0.6), ("shell", 350, 0.85), ("flat", 90, 0.6)])
def test_the_sequence_is_the_plain_one(spark, monkeypatch, name, most, fraction):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "STEP", 0.04 if name == "shell" else 0.1)
    options = SimplifyOptions(fraction, mode="sequential")
    work = S._Sequence(SURFACES[name](spark), options)
    plain = Plain(work.vertices.collect(), work.faces.collect())
    goal = max(1, math.ceil(fraction * len(plain.at)))
    steps = 0
    while work.totals()["open"] and work.run():
        steps += 1
    assert steps >= 2 or most > 1000
    made = 0
    while len(plain.at) > goal:
        for rank in sorted(map(plain.rank, plain.edges())):
            if plain.sound(*rank[3:]):
                plain.collapse(*rank[3:])
                made += 1
                break
        else:
            break
    assert made > 5
    assert found(work) == plain.state()


@pytest.mark.parametrize("batch", [0, 3])
@pytest.mark.parametrize("name", ["bumpy", "shell"])
def test_a_batch_is_a_serial_pass(spark, monkeypatch, name, batch):
    """Each slab chooses by itself, what is chosen is merged and filtered again, and made in order."""
    monkeypatch.setattr(S, "MOST", 70)
    work = S._Slabs(SURFACES[name](spark), SimplifyOptions(0.0, threads=2, batch_size=batch))
    work.deal()
    plain = Plain(work.vertices.collect(), work.faces.collect())
    size = max(work.sizes.collect())["size"]
    assert size <= 70
    slab = {v: (k - 1) // size for v, k in plain.slab.items()}
    assert len(set(slab.values())) > 1
    rims = {r["vid"] for r in work.vertices.where("rim = 1").collect()}
    chosen = []
    for s in set(slab.values()):
        own = [e for e in plain.edges() if {slab[v] for v in plain.near(e[0]) | plain.near(e[1])} == {s} and not rims & set(e) and plain.sound(*e)]
        ranks = sorted(map(plain.rank, own))
        if not batch:
            ranks = ranks[: math.ceil(S.SHARE * len(ranks))]
        claimed, mine = set(), []
        for r in ranks:
            claim = {*r[3:], *plain.opposite(*r[3:])}
            if not claim & claimed and (not batch or len(mine) < batch):
                claimed |= claim
                mine.append(r)
        chosen += mine
    claimed, filtered = set(), []
    for r in sorted(chosen):
        claim = {*r[3:], *plain.opposite(*r[3:])}
        if not claim & claimed:
            claimed |= claim
            filtered.append(r)
    assert len(filtered) == len(chosen)  # claims of slabs never meet
    for r in filtered:
        if plain.sound(*r[3:]):
            plain.collapse(*r[3:])
    work.work(work.regions(False), work.edges, S._Rule(False, batch))
    assert found(work) == plain.state()


def test_prices_are_those_of_all_edges(spark, monkeypatch):
    """After rounds, the maintained edges are what pricing all of them anew gives."""
    monkeypatch.setattr(S, "MOST", 80)
    work = S._Slabs(shell(spark, "/root/testdata/sf0.001"), SimplifyOptions(0.6, threads=2))
    assert work.run()
    plain = Plain(work.vertices.collect(), work.faces.collect())
    kept = {(r["hi"], r["lo"]): r["cost"] for r in work.edges.collect()}
    assert kept == {e: plain.cost(*e)[0] for e in plain.edges()}


def test_no_more_than_the_goal_and_the_cheapest_first(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 40)
    s = bumpy(spark, 12)
    for mode in ("sequential", "partitioned_batch"):
        done = S.simplify(s, SimplifyOptions(0.9, threads=3, mode=mode)).surface
        assert done.vertices.count() == math.ceil(0.9 * 144)


def test_pivots_are_tested_beside_the_determinant():
    # the determinant passes, but eliminating meets a pivot that is too small
    q = (1e5, 0.0, 0.0, 0.0, 1e5, 0.0, 0.0, 5e-9, 1.0, 0.0)
    assert solve([[1e5, 0, 0], [0, 1e5, 0], [0, 0, 5e-9]], [0, 0, -1.0]) is None
    assert price(q, (0.0, 0.0, 0.0), (2.0, 4.0, 6.0))[2] == (1.0, 2.0, 3.0)
    assert solve([[0, 2, 0], [1, 0, 0], [0, 0, 4]], [2, 3, 8]) == (3.0, 1.0, 2.0)
