"""Exact order statistics by histogram refinement.

Each pass counts, in equal steps of value, the rows of the ranges that still hold
a wanted rank, and goes on with the steps that hold it, from their own smallest to
their largest value. No task or driver has more than BINS rows a range, however
many rows or distinct values there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Rows of all ranges together that are looked at directly.
FEW_ROWS = 5_000


def _bin(x: Column, lo: float, hi: float) -> Column:
    """The step of a range that a value falls into; never smaller for a larger value."""
    if math.isinf(hi - lo):
        share = (x / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
    else:
        share = (x - lo) / F.lit(hi - lo)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0, ascending) of a numeric column. Nulls have no rank; infinities are at the ends, NaN comes last of all."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    x, inf = F.col("x"), float("inf")
    finite = ~F.isnan(x) & (F.abs(x) < inf)
    t = values.agg(F.count_if(x == -inf).alias("low"), F.count_if(finite).alias("finite"), F.count_if(x == inf).alias("high"), F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).first()
    out: dict[int, float] = {}
    open_: dict[tuple[float, float], list[tuple[int, int]]] = {}  # (lo, hi): (rank, rank within the range)
    for r in {*ranks}:
        k = r - t["low"]
        if k < 0:
            out[r] = -inf
        elif k < t["finite"]:
            open_.setdefault((t["lo"], t["hi"]), []).append((r, k))
        else:
            out[r] = inf if k - t["finite"] < t["high"] else math.nan
    size = {key: t["finite"] for key in open_}
    while open_:
        for lo, hi in [*open_]:
            if lo == hi:
                out |= {r: lo for r, _ in open_.pop((lo, hi))}
        if not open_:
            break
        ranges, of = [*open_], F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(ranges):
            of = F.when(finite & x.between(lo, hi), F.lit(i)).otherwise(of)
        inside = values.select("x", of.alias("i")).where("i is not null")
        if sum(size[k] for k in ranges) <= FEW_ROWS:
            held: dict[int, list[float]] = {}
            for r in inside.collect():
                held.setdefault(r["i"], []).append(r["x"])
            for i, key in enumerate(ranges):
                own = sorted(held[i])
                out |= {r: own[k] for r, k in open_[key]}
            break
        step = F.lit(0)
        for i, (lo, hi) in enumerate(ranges):
            step = F.when(F.col("i") == i, _bin(x, lo, hi)).otherwise(step)
        counted = inside.groupBy("i", step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        following: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for i, key in enumerate(ranges):
            own = sorted((c for c in counted if c["i"] == i), key=lambda c: c["b"])
            for r, k in open_[key]:
                for c in own:
                    if k < c["n"]:
                        following.setdefault((c["lo"], c["hi"]), []).append((r, k))
                        size[c["lo"], c["hi"]] = c["n"]
                        break
                    k -= c["n"]
        open_ = following
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> tuple[int, dict[float, float | None]]:
    """How many values there are, and their quantiles, interpolated linearly; None where there is no value."""
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return 0, dict.fromkeys(shares)
    at = {q: q * (n - 1) for q in shares}
    found = order_statistics(rows, column, [f(p) for p in at.values() for f in (math.floor, math.ceil)])
    value = lambda p: found[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)]
    return n, {q: value(p) for q, p in at.items()}
