"""Vectors, planes and quadrics as column expressions, so that they stay in generated code.

A vector is a tuple of three columns; a quadric, being symmetric, is a tuple of ten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: The ten entries of a symmetric 4 x 4 matrix, by row.
Q = ("aa", "ab", "ac", "ad", "bb", "bc", "bd", "cc", "cd", "dd")
# Below this determinant, or with a pivot below the second (absolute), a quadric has no single best point.
SINGULAR, LEAST_PIVOT = 1e-8, 1e-12


def vec(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def negate(a: Vec) -> Vec:
    return -a[0], -a[1], -a[2]


def divide(a: Vec, k: Column) -> Vec:
    """By a column that may be zero, which gives the zero vector."""
    return tuple(F.when(k == 0, F.lit(0.0)).otherwise(F.try_divide(c, k)) for c in a)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    return divide(a, length(a))


def outer(a: Sequence[Column]) -> tuple[Column, ...]:
    """The ten entries of a aT for four columns."""
    return tuple(a[i] * a[j] for i in range(4) for j in range(i, 4))


def quadric(prefix: str = "q_") -> tuple[Column, ...]:
    return tuple(F.col(prefix + k) for k in Q)


def add_quadrics(p: Sequence[Column], q: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(p, q, strict=True))


def quadric_error(q: Sequence[Column], p: Vec) -> Column:
    """pT Q p for the point p; it may be slightly negative."""
    aa, ab, ac, ad, bb, bc, bd, cc, cd, dd = q
    x, y, z = p
    return x * (aa * x + ab * y + ac * z + ad) + y * (ab * x + bb * y + bc * z + bd) + z * (ac * x + bc * y + cc * z + cd) + (ad * x + bd * y + cd * z + dd)


def determinant(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def upper(q: Sequence[Column]) -> list[list[Column]]:
    aa, ab, ac, _, bb, bc, _, cc, _, _ = q
    return [[aa, ab, ac], [ab, bb, bc], [ac, bc, cc]]


def solve(q: Sequence[Column]) -> tuple[Column, Vec]:
    """Determinant of the upper block, and the point where the quadric's gradient vanishes (Cramer's rule).

    The quotients are null where the determinant is zero.
    """
    m, right = upper(q), (-q[3], -q[6], -q[8])
    whole = determinant(m)
    replaced = [[[right[r] if c == k else m[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    return whole, tuple(F.try_divide(determinant(r), whole) for r in replaced)


def least_pivot(m: Sequence[Sequence[Column]]) -> Column:
    """The least pivot (absolute) of an elimination that takes the largest entry of each column; null if one is 0.

    Pivots are quotients of leading minors, and choosing rows chooses among the minors: the first is the
    largest entry of the first column, the first two make the largest 2 x 2 minor with that row, all three
    make the determinant.  So no elimination has to be written out.
    """
    first = [F.abs(m[k][0]) for k in range(3)]
    pair = {(i, j): F.abs(m[i][0] * m[j][1] - m[j][0] * m[i][1]) for i, j in ((0, 1), (0, 2), (1, 2))}
    one = F.greatest(*first)
    two = F.when(first[0] == one, F.greatest(pair[0, 1], pair[0, 2])).when(first[1] == one, F.greatest(pair[0, 1], pair[1, 2])).otherwise(F.greatest(pair[0, 2], pair[1, 2]))
    second, third = F.try_divide(two, one), F.try_divide(F.abs(determinant(m)), two)
    return F.when(second.isNotNull() & third.isNotNull(), F.least(one, second, third))


def best_point(q: Sequence[Column], a: Vec, b: Vec) -> Vec:
    """Where the quadric is least, or halfway between a and b if that isn't determined: the determinant is
    small, or a pivot of the elimination is."""
    whole, point = solve(q)
    known = (F.abs(whole) >= SINGULAR) & F.coalesce(least_pivot(upper(q)) >= LEAST_PIVOT, F.lit(False))
    return tuple(F.when(known & p.isNotNull(), p).otherwise((x + y) / 2) for p, x, y in zip(point, a, b, strict=True))


def plane(p0: Vec, p1: Vec, p2: Vec) -> tuple[Vec, Column, Column]:
    """Unit normal (zero for a face without area), offset and area of a triangle."""
    c = cross(sub(p1, p0), sub(p2, p0))
    size = length(c)
    n = divide(c, size)
    return n, -dot(n, p0), size * 0.5


def least_first(v: Vec) -> Vec:
    """The corners turned so that the least id is first; the winding stays."""
    a, b, c = v
    first, second = (a <= b) & (a <= c), (b < a) & (b <= c)
    return (
        F.when(first, a).when(second, b).otherwise(c),
        F.when(first, b).when(second, c).otherwise(a),
        F.when(first, c).when(second, a).otherwise(b),
    )


def edge_side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Twice the signed area of (a, b, point) in the plane."""
    return (x - ax) * (by - ay) - (y - ay) * (bx - ax)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero, so that results don't depend on the order of sums."""
    return F.round(c, digits) + F.lit(0.0)
