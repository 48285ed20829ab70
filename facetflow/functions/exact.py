"""Sums of doubles that don't depend on the order of the rows.

A double is cut into whole numbers of six fixed units, 2^32 apart.  Integers add up the same in any order and
any number of partial sums; the total is put together in wide decimals and rounded once.  So a sum has
the same bits for every number of partitions, and they are those of the exact sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents of the units.  What lies below the least (2e-34) is cut off each term.
UNITS = (48, 16, -16, -48, -80, -112)
#: Terms from here on, and those that aren't finite, are summed as they are: right, but in some order.
WILD = 2.0**78


def _parts(c: Column) -> list[Column]:
    tame = F.when(F.abs(c) < WILD, c)
    rests = [tame, *(tame % F.lit(2.0**u) for u in UNITS[:-1])]
    return [(rest * F.lit(2.0**-u)).cast("long") for rest, u in zip(rests, UNITS, strict=True)]


def _wide(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def _power(n: int) -> Column:
    return F.lit(str(2**n)).cast("decimal(38,0)")


def _three(a: Column, b: Column, c: Column) -> Column:
    """Three neighbouring units as one whole number of the least."""
    return _wide(_wide(_wide(a) * _power(64)) + _wide(_wide(b) * _power(32)) + _wide(c))


def _halves(p: Column) -> Column:
    """u in units of 2^-16 and l in units of 2^-112."""
    return F.struct(_three(p["s0"], p["s1"], p["s2"]).alias("u"), _three(p["s3"], p["s4"], p["s5"]).alias("l"), p["w"].alias("w"))


def _carried(p: Column) -> Column:
    """What l holds beyond 2^96 moves up."""
    rest = _wide(p["l"] % _power(96))
    up = _wide((p["l"] - rest) / _power(96))
    return F.struct(_wide(p["u"] + up).alias("u"), rest.alias("l"), p["w"].alias("w"))


def _total(p: Column) -> Column:
    up, low = p["u"], p["l"]
    small = _wide(_wide(up * _power(96)) + low).cast("double") * F.lit(2.0**-112)
    # 62 bits and more: all that matters of the rest is whether there is any, and on which side
    rest = _wide(low % _power(64))
    high = _wide((low - rest) / _power(64))
    large = _wide(_wide(up * _power(33)) + _wide(high * _wide(2)) + _wide(F.signum(rest.cast("double")).cast("long"))).cast("double") * F.lit(2.0**-49)
    huge = _wide(_wide(up * _wide(2)) + _wide(F.signum(low.cast("double")).cast("long"))).cast("double") * F.lit(2.0**-17)
    exact = F.when(F.abs(up) < _power(29), small).when(F.abs(up) < _power(61), large).otherwise(huge)
    return F.when(p["w"].isNull(), exact).otherwise(p["w"] + F.coalesce(exact, F.lit(0.0)))


def exact_sums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and the sum of each column within them; null where a column only holds nulls.

    A key may have 2^30 terms; beyond that an overflow is an error (with ANSI on, as by default).
    """
    aggregates = []
    for c in columns:
        aggregates += [F.sum(p).alias(f"_s{k}_{c}") for k, p in enumerate(_parts(F.col(c)))]
        aggregates.append(F.sum(F.when(F.abs(c) >= WILD, F.col(c))).alias(f"_w_{c}"))
    sums = df.groupBy(*keys).agg(*aggregates)
    parts = F.array(*(F.struct(*(F.col(f"_s{k}_{c}").alias(f"s{k}") for k in range(len(UNITS))), F.col(f"_w_{c}").alias("w")) for c in columns))
    # one expression for all columns: written out for each, it takes longer to compile than to run
    totals = F.transform(F.transform(F.transform(parts, _halves), _carried), _total)
    return sums.select(*keys, totals.alias("_totals")).select(*keys, *(F.col("_totals")[k].alias(c) for k, c in enumerate(columns)))
