"""A bounded piece of a mesh within one task: its own vertices, those around them, and the faces that touch its own.

Vertices have fixed random priorities.  Of the ends of an edge the one with the higher priority survives, so the
order of equal costs never changes for the worse as vertices merge, and isn't tied to places or ids.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator, Sequence

#: Below this determinant, or pivot (absolute), a quadric has no single best point: a fixed value.
SINGULAR = 1e-8

Point = tuple[float, float, float]
Rank = tuple[float, int, int, int, int]


def solve(m: list[list[float]], r: list[float]) -> Point | None:
    """The solution of m p = r by elimination with row choice; None where a pivot vanishes."""
    rows = [[*own, x] for own, x in zip(m, r, strict=True)]
    for k in range(3):
        best = max(range(k, 3), key=lambda i: abs(rows[i][k]))
        if abs(rows[best][k]) < SINGULAR:
            return None
        rows[k], rows[best] = rows[best], rows[k]
        for i in range(k + 1, 3):
            f = rows[i][k] / rows[k][k]
            rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
    z = rows[2][3] / rows[2][2]
    y = (rows[1][3] - rows[1][2] * z) / rows[1][1]
    return (rows[0][3] - rows[0][1] * y - rows[0][2] * z) / rows[0][0], y, z


def price(q: Sequence[float], a: Point, b: Point) -> tuple[float, float, Point]:
    """Cost of an edge with the quadric q, rounded; a bound that no later cost falls below; its best point.

    Where the point is determined, cost never falls as quadrics are added; halfway between the ends it may fall,
    but not below 0."""
    aa, ab, ac, ad, bb, bc, bd, cc, cd, dd = q
    det = aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)
    point = solve([[aa, ab, ac], [ab, bb, bc], [ac, bc, cc]], [-ad, -bd, -cd]) if abs(det) >= SINGULAR else None
    free = point is None
    x, y, z = p = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, (a[2] + b[2]) / 2) if point is None else point
    cost = x * (aa * x + ab * y + ac * z + ad) + y * (ab * x + bb * y + bc * z + bd) + z * (ac * x + bc * y + cc * z + cd) + (ad * x + bd * y + cd * z + dd)
    cost = round(cost, 6) + 0.0
    return cost, min(cost, 0.0) if free else cost, p


class Patch:
    def __init__(self) -> None:
        self.place: dict[int, Point] = {}
        self.quadric: dict[int, tuple[float, ...]] = {}
        self.priority: dict[int, int] = {}
        self.rims: set[int] = set()
        self.own: set[int] = set()
        self.faces: dict[int, tuple[int, int, int]] = {}
        self.around: dict[int, set[int]] = {}
        #: by (survivor, other): cost, bound, point
        self.prices: dict[tuple[int, int], tuple[float, float, Point]] = {}
        self.moved: set[int] = set()
        self.gone: set[int] = set()
        self.changed: set[int] = set()
        self.lost: set[int] = set()

    def add_face(self, fid: int, corners: tuple[int, int, int]) -> None:
        self.faces[fid] = corners
        for v in corners:
            self.around.setdefault(v, set()).add(fid)

    def key(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if (self.priority[a], a) > (self.priority[b], b) else (b, a)

    def rank(self, key: tuple[int, int]) -> Rank:
        return self.prices[key][0], self.priority[key[0]], self.priority[key[1]], *key

    def near(self, v: int) -> set[int]:
        return {w for f in self.around.get(v, ()) for w in self.faces[f]} - {v}

    def closed(self, v: int) -> bool:
        """Whether the faces of v form one cycle."""
        ring = {}
        for f in self.around.get(v, ()):
            a, b, c = self.faces[f]
            x, y = (b, c) if a == v else (c, a) if b == v else (a, b)
            if x in ring:
                return False
            ring[x] = y
        if not ring:
            return False
        first = at = next(iter(ring))
        for k in range(1, len(ring) + 1):
            at = ring.get(at)
            if at is None or (at == first) != (k == len(ring)):
                return False
        return True

    def opposite(self, a: int, b: int) -> set[int]:
        return {w for f in self.around[a] & self.around[b] for w in self.faces[f]} - {a, b}

    def sound(self, a: int, b: int) -> bool:
        """Whether the edge may collapse: two faces, closed ends, no common neighbour but those opposite."""
        if not (self.around.get(a) and self.around.get(b)) or len(self.around[a] & self.around[b]) != 2:
            return False
        return self.near(a) & self.near(b) == self.opposite(a, b) and self.closed(a) and self.closed(b)

    def merged(self, a: int, b: int) -> tuple[float, float, Point]:
        q = [x + y for x, y in zip(self.quadric[a], self.quadric[b], strict=True)]
        return price(q, self.place[a], self.place[b])

    def collapse(self, stays: int, goes: int) -> None:
        point = self.prices[stays, goes][2]
        for w in self.near(goes) | self.near(stays):
            self.prices.pop(self.key(goes, w), None)
            self.prices.pop(self.key(stays, w), None)
        for f in list(self.around[goes]):
            corners = tuple(stays if v == goes else v for v in self.faces[f])
            if len(set(corners)) < 3:
                for v in self.faces[f]:
                    self.around[v].discard(f)
                del self.faces[f]
                self.lost.add(f)
            else:
                # the corner with the least id comes first, as everywhere
                k = corners.index(min(corners))
                self.faces[f] = corners[k:] + corners[:k]
                self.around[stays].add(f)
                self.changed.add(f)
        self.place[stays] = point
        self.quadric[stays] = tuple(x + y for x, y in zip(self.quadric[stays], self.quadric[goes], strict=True))
        for known in (self.place, self.quadric, self.around):
            del known[goes]
        self.own.discard(goes)
        self.moved.discard(goes)
        self.moved.add(stays)
        self.gone.add(goes)

    def sequence(self, bound: tuple[float, int] | None, most: int | None) -> Iterator[tuple[Rank, tuple[int, int]]]:
        """Collapses the least sound edge of the own vertices again and again, up to the bound (cost, priority),
        most times.  Gives the greatest rank so far and the edge of each."""

        def allowed(key: tuple[int, int]) -> bool:
            return bound is None or (self.prices[key][0], self.priority[key[0]]) <= bound

        heap = [self.rank(k) for k in self.prices if allowed(k)]
        heapq.heapify(heap)
        greatest: Rank | None = None
        for _ in itertools.count() if most is None else range(most):
            while heap:
                rank = heapq.heappop(heap)
                key = rank[3:]
                # what isn't sound now is offered again when something around it changes
                if key in self.prices and self.prices[key][0] == rank[0] and self.sound(*key):
                    break
            else:
                return
            greatest = rank if greatest is None else max(greatest, rank)
            self.collapse(*key)
            stays = key[0]
            ring = self.near(stays)
            for w in ring & self.own:
                if stays not in self.rims and w not in self.rims:
                    self.prices[self.key(stays, w)] = self.merged(stays, w)
            offered = {self.key(v, w) for v in (ring | {stays}) & self.own for w in self.near(v) & self.own}
            for k in offered:
                if k in self.prices and allowed(k):
                    heapq.heappush(heap, self.rank(k))
            yield greatest, key

    def edges_of_moved(self) -> Iterator[tuple[int, int]]:
        """The edges of survivors that may ever collapse."""
        seen = set()
        for v in self.moved - self.rims:
            for w in self.near(v) - self.rims:
                key = self.key(v, w)
                if key not in seen and len(self.around[v] & self.around[w]) >= 2:
                    seen.add(key)
                    yield key

    def new_edges(self) -> Iterable[tuple[tuple[int, int], tuple[float, float, Point]]]:
        """Prices of the edges of survivors that may ever collapse."""
        for key in self.edges_of_moved():
            yield key, self.merged(*key)
