"""Exact quantiles of whole columns without one task holding the column.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, which is fine per station but not for a column of a large table.
Here each wanted order statistic is located by value-range narrowing:

1. one pass: count, min and max per group;
2. per pass, the rows inside each target's current value range are split
   into ``buckets`` equal-width ranges and counted (with each range's min
   and max); the range holding the target rank becomes the new range.
   Bucket assignment is monotone in the value, so a bucket's [min, max] holds
   exactly that bucket's rows;
3. once a range holds at most ``exact_limit`` rows (or a single value), the
   rows of all targets' ranges are ranked exactly in one windowed job.

The result is interpolated as ``percentile`` / pandas / ``quantile_cont``:
position p·(n-1) between the two neighbouring order statistics.  Only
bucket counts (≤ buckets × targets rows) and the final values reach the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(long_df: DataFrame, group: str, value: str, probs: Sequence[float],
                    buckets: int = 1024, exact_limit: int = 100_000) -> dict[tuple[str, float], float | None]:
    spark = long_df.sparkSession
    data = long_df.select(F.col(group).cast("string").alias("_g"), F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    # ranges are narrowed over the finite values; infinities are counted on either side
    finite = F.abs("_v") < F.lit(math.inf)
    stats = {r._g: (r.n, r.lo, r.hi, r.below, r.above) for r in
             data.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(finite, F.col("_v"))).alias("lo"),
                                    F.max(F.when(finite, F.col("_v"))).alias("hi"),
                                    F.count_if(F.col("_v") == -math.inf).alias("below"),
                                    F.count_if(F.col("_v") == math.inf).alias("above")).collect()}
    # one target per needed order statistic: [group, rank, lo, hi, below, count_in_range, value]
    targets: dict[tuple[str, int], list] = {}
    for g, (n, lo, hi, below, above) in stats.items():
        for p in probs:
            pos = p * (n - 1)
            for r in {math.floor(pos), math.ceil(pos)}:
                if r < below or r >= n - above:
                    targets[(g, r)] = [None, None, 0, n, -math.inf if r < below else math.inf]
                else:
                    targets[(g, r)] = [lo, hi, below, n - below - above, lo if lo == hi else None]
    schema = "_tg string, _tid long, _lo double, _hi double"
    keys = list(targets)
    for _ in range(64):  # each pass shrinks a range by ~buckets; 64 passes exceed double precision
        active = [i for i, t in enumerate(keys)
                  if targets[t][4] is None and targets[t][3] > exact_limit]
        if not active:
            break
        tdf = spark.createDataFrame(
            [(keys[i][0], i, targets[keys[i]][0], targets[keys[i]][1]) for i in active], schema)
        half = lambda c: F.col(c) / 2  # noqa: E731 - the difference of two finite halves is finite
        b = F.least(F.lit(buckets - 1),
                    F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * buckets).cast("long"))
        rows = (data.join(F.broadcast(tdf), F.col("_g") == F.col("_tg"))
                .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy("_tid", b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx")).collect())
        per: dict[int, list] = {}
        for r in rows:
            per.setdefault(r._tid, []).append((r._b, r.c, r.mn, r.mx))
        for i in active:
            t = targets[keys[i]]
            rank = keys[i][1]
            cum = t[2]
            for _, c, mn, mx in sorted(per.get(i, [])):
                if cum + c > rank:
                    t[0], t[1], t[2], t[3] = mn, mx, cum, c
                    if mn == mx:
                        t[4] = mn
                    break
                cum += c
    else:
        raise RuntimeError("a quantile's range did not narrow")
    pending = [i for i, t in enumerate(keys) if targets[t][4] is None]
    if pending:
        tdf = spark.createDataFrame(
            [(keys[i][0], i, targets[keys[i]][0], targets[keys[i]][1]) for i in pending], schema)
        sel = (data.join(F.broadcast(tdf), F.col("_g") == F.col("_tg"))
               .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
               .withColumn("_rn", F.row_number().over(Window.partitionBy("_tid").orderBy("_v"))))
        want = spark.createDataFrame([(i, keys[i][1] - targets[keys[i]][2] + 1) for i in pending],
                                     "_tid long, _want long")
        for r in sel.join(F.broadcast(want), "_tid").where(F.col("_rn") == F.col("_want")).select(
                "_tid", "_v").collect():
            targets[keys[r._tid]][4] = r._v
    out: dict[tuple[str, float], float | None] = {}
    for g, (n, *_) in stats.items():
        for p in probs:
            pos = p * (n - 1)
            lo_r, hi_r = math.floor(pos), math.ceil(pos)
            a, b2 = targets[(g, lo_r)][4], targets[(g, hi_r)][4]
            out[(g, p)] = a if lo_r == hi_r else (hi_r - pos) * a + (pos - lo_r) * b2
    return out


def quantile_frame(long_df: DataFrame, group: str, value: str, probs: Sequence[float],
                   names: Sequence[str], **kw) -> DataFrame:
    """The quantiles as a DataFrame: one row per group, one column per prob."""
    q = exact_quantiles(long_df, group, value, probs, **kw)
    groups = sorted({g for g, _ in q})
    rows = [(g, *[q[(g, p)] for p in probs]) for g in groups]
    schema = f"{group} string, " + ", ".join(f"{n} double" for n in names)
    return long_df.sparkSession.createDataFrame(rows, schema)
