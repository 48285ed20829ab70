"""One batch of collapses in a slab, by arrays.

What holds of all vertices and edges of a slab (closed rings, the link condition, neighbourhoods that lie within it)
is found for all of them at once; only what was chosen is collapsed one by one, in a patch of the faces around it.
"""

from __future__ import annotations

import numpy as np

from facetflow.operators.patch import SINGULAR, Patch, Rank


def rounded(values: np.ndarray) -> np.ndarray:
    """round(x, 6) of each, to the bit: those close to halfway between two results, and huge ones, one by one."""
    scaled = values * 1e6
    out = np.rint(scaled) / 1e6
    odd = np.flatnonzero(~(np.abs(scaled) < 2.0**50) | (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + np.abs(scaled) * 2.0**-50))
    out[odd] = [round(x, 6) for x in values[odd].tolist()]
    return out


def prices(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """patch.price of many edges, to the bit: quadrics (n, 10) and ends (n, 3) in, costs, bounds and points out."""
    aa, ab, ac, ad, bb, bc, bd, cc, cd, dd = q.T
    with np.errstate(all="ignore"):
        det = aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)
        known = np.abs(det) >= SINGULAR
        rows = np.stack([np.stack(r, 1) for r in ((aa, ab, ac, -ad), (ab, bb, bc, -bd), (ac, bc, cc, -cd))], 1)
        every = np.arange(len(q))
        for k in range(3):
            best = k + np.argmax(np.abs(rows[:, k:, k]), 1)
            known &= ~(np.abs(rows[every, best, k]) < SINGULAR)
            swapped = rows[every, best].copy()
            rows[every, best] = rows[:, k]
            rows[:, k] = swapped
            for i in range(k + 1, 3):
                f = rows[:, i, k] / rows[:, k, k]
                rows[:, i] = rows[:, i] - f[:, None] * rows[:, k]
        z = rows[:, 2, 3] / rows[:, 2, 2]
        y = (rows[:, 1, 3] - rows[:, 1, 2] * z) / rows[:, 1, 1]
        x = (rows[:, 0, 3] - rows[:, 0, 1] * y - rows[:, 0, 2] * z) / rows[:, 0, 0]
        points = np.where(known[:, None], np.stack((x, y, z), 1), (a + b) / 2)
        x, y, z = points.T
        cost = x * (aa * x + ab * y + ac * z + ad) + y * (ab * x + bb * y + bc * z + bd) + z * (ac * x + bc * y + cc * z + cd) + (ad * x + bd * y + cd * z + dd)
    cost = rounded(cost) + 0.0
    return cost, np.where(known, cost, np.minimum(cost, 0.0)), points


def _owners(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For starts 5, 9 and sizes 2, 3: the owners 0 0 1 1 1 and the places 5 6 9 10 11."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def _found(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each is among sorted codes, and whether it is there."""
    at = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
    return at, codes[at] == asked if len(codes) else np.zeros(len(asked), dtype=bool)


class Slab:
    """Vertices by number, in the order of their ids, and their faces."""

    def __init__(self, n: int, faces: np.ndarray):
        self.n, self.faces = n, faces
        u, v = faces[:, [0, 1, 1, 2, 2, 0]].ravel(), faces[:, [1, 0, 2, 1, 0, 2]].ravel()
        #: neighbours, as sorted codes n * vertex + neighbour
        self.near = np.unique((u * n + v)[u != v])
        self.degree = np.bincount(self.near // max(n, 1), minlength=n)
        self.start = np.cumsum(self.degree) - self.degree

    def of_near(self, values: np.ndarray, what: np.ufunc, none: int) -> np.ndarray:
        """The least or greatest (what) of the values of each vertex's neighbours."""
        out = np.full(self.n, none, dtype=np.int64)
        some = np.flatnonzero(self.degree)
        if len(some):
            out[some] = what.reduceat(values[self.near % self.n], self.start[some])
        return out

    def closed(self) -> np.ndarray:
        """Whether the faces of each vertex form one cycle."""
        n, f = self.n, self.faces
        spokes = []
        for k in range(3):
            keep = np.ones(len(f), dtype=bool)
            for j in range(k):
                keep &= f[:, k] != f[:, j]
            spokes.append(f[keep][:, [k, (k + 1) % 3, (k + 2) % 3]])
        v, x, y = np.concatenate(spokes).T
        order = np.argsort(v * n + x, kind="stable")
        v, y, codes = v[order], y[order], (v * n + x)[order]
        good = np.zeros(n, dtype=bool)
        good[v] = True
        good[v[1:][codes[1:] == codes[:-1]]] = False
        onward, there = _found(codes, v * n + y)
        good[v[~there]] = False
        onward = np.where(there, onward, np.arange(len(v)))
        good[v[np.bincount(onward, minlength=len(v)) != 1]] = False
        # steps are doubled: in a cycle all meet its first spoke
        least = np.arange(len(v))
        for _ in range(int(np.bincount(v, minlength=1).max()).bit_length()):
            least, onward = np.minimum(least, least[onward]), onward[onward]
        good[v[least != np.searchsorted(v, v)]] = False
        return good

    def opposite(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether edges have two faces, and the corners opposite (-1 where a face has none)."""
        f, n = self.faces, self.n
        u, v, w = (f[:, list(c)].T.ravel() for c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
        code, face, third = np.minimum(u, v) * n + np.maximum(u, v), np.tile(np.arange(len(f)), 3), np.where((w == u) | (w == v), -1, w)
        keep = u != v
        order = np.lexsort((face[keep], code[keep]))
        code, face, third = (c[keep][order] for c in (code, face, third))
        first = np.ones(len(code), dtype=bool)
        first[1:] = (code[1:] != code[:-1]) | (face[1:] != face[:-1])
        code, third = code[first], third[first]
        asked = np.minimum(a, b) * n + np.maximum(a, b)
        left = np.searchsorted(code, asked, "left")
        two = np.searchsorted(code, asked, "right") - left == 2
        at = np.where(two, left, 0)
        if not len(code):
            return two, at - 1, at - 1
        return two, third[at], third[np.minimum(at + 1, len(code) - 1)]

    def sound(self, a: np.ndarray, b: np.ndarray, one: np.ndarray, other: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether edges may collapse: two faces, closed ends, no common neighbour but those opposite."""
        few, many = np.where(self.degree[a] <= self.degree[b], a, b), np.where(self.degree[a] <= self.degree[b], b, a)
        edge, at = _owners(self.start[few], self.degree[few])
        _, shared = _found(self.near, many[edge] * self.n + self.near[at] % self.n)
        common = np.bincount(edge[shared], minlength=len(a))
        different = (one >= 0).astype(np.int64) + ((other >= 0) & (other != one))
        closed = self.closed()
        return two & closed[a] & closed[b] & (common == different)


def chosen(ends: np.ndarray, opposite: np.ndarray, n: int, most: int) -> tuple[list[int], int]:
    """Edges in their order, of which none claims a corner that one before did, and how many did (as far as looked at)."""
    claimed = bytearray(n + 1)  # the last for what isn't there
    out, conflicts = [], 0
    for k, (a, b, c, d) in enumerate(zip(*ends.T.tolist(), *opposite.T.tolist(), strict=True)):
        if most and len(out) >= most:
            break
        if claimed[a] or claimed[b] or (c >= 0 and claimed[c]) or (d >= 0 and claimed[d]):
            conflicts += 1
            continue
        claimed[a] = claimed[b] = claimed[c] = claimed[d] = 1
        out.append(k)
    return out, conflicts


def batch(
    vertices: dict[str, np.ndarray], fid: np.ndarray, faces: np.ndarray, edges: dict[str, np.ndarray], share: float, most: int, limit: int | None, fresh: bool
) -> tuple[Patch, list[tuple[Rank, tuple[int, int]]], tuple[int, int, int, int]]:
    """One batch: chooses sound edges by rank, whose corners no chosen one before claims, and collapses those
    that are still sound at their turn.

    Only edges count whose ends have all their neighbours among the own vertices; without fresh, also not
    those that had so in the slabs before.  most: of chosen ones, or 0 for the cheapest share of the sound
    ones.  Gives the patch around them, what was done, and how many counted, were chosen, conflicted, and were done.

    vertices: vid, own, slab, pri, rim, place (n, 3), quadric (n, 10); edges: hi, lo, cost, point (n, 3)."""
    ids = np.unique(np.concatenate((vertices["vid"], faces.ravel())))
    n = len(ids)
    row = np.full(n, -1)
    row[np.searchsorted(ids, vertices["vid"])] = np.arange(len(vertices["vid"]))
    own = (row >= 0) & vertices["own"][row]
    pri, number = vertices["pri"][row], np.where(own, vertices["slab"][row], 0)
    slab = Slab(n, np.searchsorted(ids, faces).reshape(-1, 3))
    a, b = np.searchsorted(ids, edges["hi"]), np.searchsorted(ids, edges["lo"])
    within = slab.of_near(own.astype(np.int64), np.minimum, 1) > 0
    counts = within[a] & within[b]
    if not fresh:
        top = np.iinfo(np.int64).max
        low, high = slab.of_near(number, np.minimum, top), slab.of_near(number, np.maximum, -top)
        counts &= np.minimum(low[a], low[b]) < np.maximum(high[a], high[b])
    of = np.flatnonzero(counts)
    a, b = a[of], b[of]
    two, one, other = slab.opposite(a, b)
    good = np.flatnonzero(slab.sound(a, b, one, other, two)) if len(of) else of
    good = good[np.lexsort((edges["lo"][of[good]], edges["hi"][of[good]], pri[b[good]], pri[a[good]], edges["cost"][of[good]]))]
    if not most:
        good = good[: -int(-share * len(good) // 1)]
    picked, conflicts = chosen(np.stack((a[good], b[good]), 1), np.stack((one[good], other[good]), 1), n, most)
    good = good[picked]

    patch = Patch()
    ends = np.zeros(n, dtype=bool)
    ends[a[good]] = ends[b[good]] = True
    touching = ends[slab.faces].any(1)
    for f, corners in zip(fid[touching].tolist(), faces[touching].tolist(), strict=True):
        patch.add_face(f, tuple(corners))
    near = np.unique(slab.faces[touching])
    known = ids[near].tolist()
    at = row[near]
    patch.place = dict(zip(known, map(tuple, vertices["place"][at].tolist()), strict=True))
    patch.quadric = dict(zip(known, map(tuple, vertices["quadric"][at].tolist()), strict=True))
    patch.priority = dict(zip(known, vertices["pri"][at].tolist(), strict=True))
    patch.rims = set(ids[near][vertices["rim"][at] != 0].tolist())
    own_edges = of[good]
    done = []
    columns = (edges["cost"][own_edges], pri[a[good]], pri[b[good]], edges["hi"][own_edges], edges["lo"][own_edges])
    for rank, point in zip(zip(*(c.tolist() for c in columns), strict=True), edges["point"][own_edges].tolist(), strict=True):
        if limit is not None and len(done) >= limit:
            break
        key = rank[3:]
        if patch.sound(*key):
            patch.prices[key] = rank[0], rank[0], tuple(point)
            patch.collapse(*key)
            done.append((rank, key))
    return patch, done, (len(of), len(good), conflicts, len(done))


def new_edges(patch: Patch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """patch.new_edges as arrays: survivors, others, and their prices."""
    keys = list(patch.edges_of_moved())
    hi, lo = ([k[i] for k in keys] for i in (0, 1))
    ends = [(np.array([patch.place[v] for v in e], dtype=float).reshape(-1, 3), np.array([patch.quadric[v] for v in e], dtype=float).reshape(-1, 10)) for e in (hi, lo)]
    return np.array(hi, dtype=np.int64), np.array(lo, dtype=np.int64), prices(ends[0][1] + ends[1][1], ends[0][0], ends[1][0])
