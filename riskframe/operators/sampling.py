"""Learning-data sampling.

Every sample is exact and repeatable.  Rows are ordered by a key (60 bits of
``md5(concat_ws('|', keys..., seed))``, or a key of the caller's), then by a
hash of all their columns; rows that agree in both are copies and stand for
each other.  "The first n rows" ends at a cut (key, row hash, copies):

* the cut is located by histogram narrowing, one grouped count per pass over
  ``buckets`` ranges, until the range before it holds the first n rows exactly
  or a single value; only bucket counts (at most ``buckets`` numbers) reach the
  driver, and log(rows) / log(buckets) + 1 passes suffice for distinct keys;
* the rows are then told apart by a filter on (key, row hash): no window, no
  join, no sort, and every row is on one side exactly once;
* copies that the cut divides are counted by one grouped aggregate and dealt
  out from their count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS_HEX = 15  # 60-bit non-negative long from the md5 prefix


def hash_key(keys: Sequence[str], seed: int | str) -> Column:
    """Deterministic pseudo-random order key, computable in SQL engines too."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS_HEX), 16, 10).cast("long")


def _narrow(df: DataFrame, key: str, lo: int, hi: int, n: int, buckets: int) -> tuple[int, int, int]:
    """Narrow [lo, hi) to the range of ``key`` that holds the n-th row (n >= 1): (lo, hi, below), with
    ``below`` rows under lo.  It ends at a range of one value, or one whose rows all belong to the first n."""
    below = 0
    while True:
        step = max(1, -(-(hi - lo) // buckets))
        bucket = F.call_function("div", F.col(key) - F.lit(lo), F.lit(step))
        rows = (df.where(F.col(key).between(lo, hi - 1)).groupBy(bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("c")).collect())
        for b, c in sorted((int(r.b), int(r.c)) for r in rows):
            if below + c >= n:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step)
                if below + c == n or step == 1:
                    return lo, hi, below
                break
            below += c
        else:
            raise RuntimeError("the rows changed between two passes; sample a written table")


def _dealt(df: DataFrame, n: int, order_key: Column, buckets: int) -> DataFrame:
    """``df`` with a boolean ``_first``: true for its first ``n`` rows.  A null order key is an error."""
    cols = df.columns
    keyed = df.withColumns({"_k": order_key.cast("long"), "_h": F.shiftrightunsigned(F.xxhash64(*cols), 1)})
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("keys"), F.min("_k").alias("lo"),
                     F.max("_k").alias("hi")).first()
    if size["keys"] < size["n"]:
        raise ValueError(f"{size['n'] - size['keys']} rows have no order key")
    if n <= 0 or n >= size["n"]:
        return df.withColumn("_first", F.lit(n > 0))
    lo, hi, below = _narrow(keyed, "_k", size["lo"], size["hi"] + 1, n, buckets)
    inside = keyed.where(F.col("_k").between(lo, hi - 1))
    left, tied = n - below, inside.count()
    if left == tied:
        return keyed.withColumn("_first", F.col("_k") <= hi - 1).select(*cols, "_first")
    # one key value, more rows than are wanted: the row hash decides
    h_lo, h_hi, h_below = _narrow(inside, "_h", 0, 1 << 63, left, buckets)
    edge = (F.col("_k") == lo) & F.col("_h").between(h_lo, h_hi - 1)
    first = (F.col("_k") < lo) | ((F.col("_k") == lo) & (F.col("_h") <= h_hi - 1))
    left -= h_below
    copies = keyed.where(edge).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    if copies.agg(F.sum("_n")).first()[0] == left:
        return keyed.withColumn("_first", first).select(*cols, "_first")
    # rows of one hash: copies of one row, but for a collision of 63 bits
    block = 1 << 16
    w = Window.orderBy(*cols)  # one row for each different row of that hash
    numbered = (copies.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
                .withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {block})")))
                .repartition("_block")
                .withColumn("_i", F.explode(F.expr(f"sequence(_block * {block}, least(_n, (_block + 1) * {block}) - 1)"))))
    split = numbered.select(*cols, (F.col("_before") + F.col("_i") < left).alias("_first"))
    return keyed.where(~edge).select(*cols, first.alias("_first")).unionByName(split)


def first_n(df: DataFrame, n: int, order_key: Column, buckets: int = 4096) -> DataFrame:
    """The ``n`` rows with the smallest ``order_key`` (a long; ties in the order of a hash of all columns).
    Exact; see the module doc for the plan."""
    if n <= 0:
        return df.limit(0)
    return _dealt(df, n, order_key, buckets).where("_first").drop("_first")


def downsample(df: DataFrame, label: str, n_negative: int, keys: Sequence[str], seed: int = 123,
               negative=0) -> DataFrame:
    """M1: all positives plus ``n_negative`` hash-chosen negatives."""
    neg = df.where(F.col(label) == negative)
    pos = df.where(F.col(label) != negative)
    chosen = first_n(neg, n_negative, hash_key(keys, seed))
    return pos.unionByName(chosen)


def undersample_parity(df: DataFrame, label: str, keys: Sequence[str], seed: int = 123) -> DataFrame:
    """M2: the majority class cut down to the minority's size (hash-chosen).
    One count action fixes n (the minority size)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda k: (counts[k], str(k)))
    majority = [k for k in counts if k != minority]
    out = df.where(F.col(label) == minority)
    for m in majority:
        part = df.where(F.col(label) == m)
        out = out.unionByName(first_n(part, counts[minority], hash_key(keys, seed)))
    return out


def split_random(df: DataFrame, keys: Sequence[str], fraction: float = 0.8, seed: int = 123,
                 out: str = "split") -> DataFrame:
    """M4: exact ``ceil(fraction * n)`` rows to 'train' by hash order, rest 'test'."""
    return split_ordered(df, hash_key(keys, seed), fraction, out)


def split_ordered(df: DataFrame, order_key: Column, fraction: float = 0.8, out: str = "split",
                  buckets: int = 4096) -> DataFrame:
    """M5: the first ``ceil(fraction * n)`` rows of an explicit order -> 'train', the rest -> 'test'.
    Every row is returned once; rows of one key may be divided."""
    dealt = _dealt(df, math.ceil(fraction * df.count()), order_key, buckets)
    return dealt.withColumn(out, F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c) per class (a tiny aggregate)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias(out))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the class weight to every row (broadcast of k rows)."""
    return df.join(F.broadcast(class_weights(df, label, out).drop("n_c")), label)


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 123,
          grid: Sequence[str] | None = None, cell: float | None = None) -> DataFrame:
    """M3: SMOTE over-sampling of the minority class up to the majority's size.

    Neighbours are the exact k nearest minority rows: by pivot partitions over
    all features (``knn_pivots``), or on a grid of two of them (``knn_self``)
    where ``grid`` or ``cell`` is given; no all-pairs join.  Each minority row makes ``q`` or ``q + 1`` synthetic rows
    (``q = n_new // n_min``; the ``n_new % n_min`` rows with the smallest
    hash make one more), each one ``x + u * (x_nn - x)`` with the neighbour
    and ``u`` drawn from a hash of (row, copy, seed): exact and repeatable.
    Returns the synthetic rows only: (key of the source row, copy, label,
    features); other columns are null.
    """
    from .knn import knn_self
    from .pivots import knn_pivots

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    n_min, n_max = counts[minority], max(counts.values())
    n_new = n_max - n_min
    feats = list(features)
    mino = df.where(F.col(label) == minority).select(key, *feats)
    if n_new <= 0 or n_min < 2:
        return mino.limit(0).withColumn("copia", F.lit(0).cast("long")).withColumn(label, F.lit(minority))
    kk = min(k, n_min - 1)
    nn = knn_self(mino, key, feats, kk, grid=grid, cell=cell) if grid or cell else knn_pivots(mino, key, feats, kk)
    q, extra = divmod(n_new, n_min)
    plus = first_n(mino.select(key), extra, hash_key([key], f"{seed}-extra"))
    plus = plus.withColumn("_plus", F.lit(1))
    reps = mino.join(plus, key, "left").withColumn("_n", F.lit(q) + F.coalesce("_plus", F.lit(0)))
    copies = reps.where(F.col("_n") > 0).withColumn("copia", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    h = F.concat_ws("|", F.col(key).cast("string"), F.col("copia").cast("string"), F.lit(str(seed)))
    copies = copies.withColumns({
        "nn_rank": (F.conv(F.substring(F.md5(h), 1, 8), 16, 10).cast("long") % kk + 1),
        "_u": F.conv(F.substring(F.md5(F.concat(h, F.lit("u"))), 1, 13), 16, 10).cast("double") / float(16 ** 13),
    })
    nb = nn.select(key, "nn_rank", "nn_key")
    other = mino.select(F.col(key).alias("nn_key"), *[F.col(c).alias(f"_nb_{c}") for c in feats])
    j = copies.join(nb, [key, "nn_rank"]).join(other, "nn_key")
    return j.select(key, F.col("copia").cast("long").alias("copia"), F.lit(minority).alias(label),
                    *[(F.col(c) + F.col("_u") * (F.col(f"_nb_{c}") - F.col(c))).alias(c) for c in feats])
