"""Exact quantiles (linear interpolation) by counting, without gathering values.

The order statistics that a quantile needs are found by narrowing intervals:

1. one pass takes count, minimum, maximum and a mergeable sketch of bounded size of every
   column; the sketch only brackets each wanted rank;
2. each further pass cuts every open interval into BUCKETS equal parts and
   counts values per part (with the part's own minimum and maximum) and below the interval, by partial
   aggregation; the part that holds the wanted rank is the next interval. A bracket that
   turns out not to hold its rank is replaced by the whole range;
3. an interval is closed when its minimum equals its maximum.

A pass shuffles and returns at most (open intervals) x BUCKETS rows per task,
whatever the number of rows; no value is collected. At
least two parts hold values in each pass (those of the minimum and maximum), so
every pass narrows every open interval; two or three passes are usual, five or six close
intervals of 64-bit doubles unless the values span hundreds of orders of magnitude.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import write_scratch

BUCKETS = 1024
SKETCH = 1000  # the sketch's rank error is one part in so many


def _part(x: Column, lo: float, hi: float) -> Column:
    """Number of the equal part of [lo, hi] that holds ``x``."""
    if lo == hi:
        return F.lit(0)
    if math.isinf(hi - lo):  # halves, so that the width does not overflow
        x, lo, hi = x * 0.5, lo * 0.5, hi * 0.5
    return F.least(F.floor((x - lo) / F.lit(hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _narrow(df: DataFrame, intervals: list[tuple[str, float, float]]) -> dict[int, list[tuple[int, float, float, bool]]]:
    """(count, least, greatest, within) of the non-empty parts, in order, by interval number; the values below an interval
    come first, as a part that is not within it."""
    hits = []
    for k, (c, lo, hi) in enumerate(intervals):
        x = F.col(c).cast("double")
        # part -1: values below the interval
        hits.append(F.when(x <= hi, F.struct(F.lit(k).alias("k"), F.when(x < lo, -1).otherwise(_part(x, lo, hi)).alias("part"), x.alias("x"))))
    tall = df.select(F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    rows = tall.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["part"])):
        out.setdefault(r["k"], []).append((r["n"], r["lo"], r["hi"], r["part"] >= 0))
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], extra: Sequence = ()) -> tuple[dict, object]:
    """({(col, q): value or None}, first-pass row). NULL and NaN are no values.

    ``extra`` aggregates ride along in the first pass and may reference only
    ``cols``. The projected columns are written once, so that the passes do not
    recompute the input's lineage.
    """
    stored = write_scratch(df.select(*[F.col(c) for c in cols]), "quantiles")
    clean = stored.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    aggs = []
    for c in cols:
        near = [min(1.0, max(0.0, q + d / SKETCH)) for q in qs for d in (-3, 3)]
        aggs += [F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"),
                 F.percentile_approx(c, near, SKETCH).alias(f"{c}__near")]
    first = clean.agg(*aggs).collect()[0]
    row = stored.agg(*extra).collect()[0] if extra else first

    # rank -> interval; a closed interval that is known to hold the rank is a value
    want: dict[tuple[str, int], tuple[float, float]] = {}
    known: dict[tuple[str, int], float] = {}
    for c in cols:
        n, whole = first[f"{c}__n"], (first[f"{c}__lo"], first[f"{c}__hi"])
        for i, q in enumerate(qs) if n else ():
            for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1))):
                if whole[0] == whole[1]:
                    known[c, k] = whole[0]
                else:
                    want.setdefault((c, k), tuple(first[f"{c}__near"][2 * i:2 * i + 2]))
    while want:
        open_ = sorted({(c, lo, hi) for (c, _), (lo, hi) in want.items()})
        parts = _narrow(clean, open_)
        number = {interval: k for k, interval in enumerate(open_)}
        for (c, k), (lo, hi) in list(want.items()):
            rank, held = k, None
            for n, least, greatest, within in parts.get(number[c, lo, hi], ()):
                if rank < n:
                    held = (least, greatest) if within else None
                    break
                rank -= n
            if held is None:
                want[c, k] = (first[f"{c}__lo"], first[f"{c}__hi"])
            elif held[0] == held[1]:
                known[c, k] = held[0]
                del want[c, k]
            else:
                want[c, k] = held
    out: dict = {}
    for c in cols:
        n = first[f"{c}__n"]
        for q in qs:
            if not n:
                out[c, q] = None
                continue
            pos = q * (n - 1)
            v0, v1 = known[c, math.floor(pos)], known[c, math.ceil(pos)]
            out[c, q] = v0 if v0 == v1 else v0 + (pos - math.floor(pos)) * (v1 - v0)
    return out, row
