"""Statistics (A17–A21): correlation, Levene's test, ACF and PACF.

All are aggregates over the data.  PACF folds the ACF *result* (``nlags``
numbers per series); only Levene's p-value runs Python, on a row per variable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import long_form


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair (long form), pairwise
    complete (rows where either value is null are skipped, as pandas).
    One aggregation pass computes all pairs."""
    cols = list(cols)
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}"))
    wide = df.agg(*aggs)
    pairs = [f"{a}|{b}" for i, a in enumerate(cols) for b in cols[i:]]
    upper = wide.unpivot([], pairs, "_pair", "corr").select(
        F.get(F.split("_pair", r"\|"), 0).alias("a"), F.get(F.split("_pair", r"\|"), 1).alias("b"), "corr")
    # both orientations from the single aggregate row set (no second pass over the input)
    both = F.array(F.struct(F.col("a").alias("var_a"), F.col("b").alias("var_b")),
                   F.struct(F.col("b").alias("var_a"), F.col("a").alias("var_b")))
    return (upper.select(F.explode(F.array_distinct(both)).alias("_o"), "corr")
            .select("_o.var_a", "_o.var_b", "corr"))


def _pair_sums(k: int):
    """Sums over the rows of a task in which both columns have a value: a row per pair of columns."""
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    low, high = np.triu_indices(k)

    def run(batches):
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = ~np.isnan(x)
            x, here = np.where(here, x, 0.0), here.astype(float)
            n += here.T @ here
            sx += x.T @ here
            sxx += (x * x).T @ here
            sxy += x.T @ x
        sums = (n[low, high], sx[low, high], sx[high, low], sxx[low, high], sxx[high, low], sxy[low, high])
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), *(pa.array(v, pa.float64()) for v in sums)],
                                         names=["i", "j", *names])
    return run


def gram_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A17 for many columns: the same rows as ``correlation_matrix`` (pairwise complete; NaN counts as
    missing, a pair without variance is null).

    One pass takes the columns' means, one the blocked Gram matrix of the centred values: each task
    multiplies its batches as matrices and sends k (k + 1) / 2 rows of sums, which one grouped
    aggregate adds.  The plan doesn't grow with the square of the number of columns."""
    cols = list(cols)
    values = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))])
    centred = values.crossJoin(F.broadcast(means)).select(*[(F.col(f"c{i}") - F.col(f"m{i}")).alias(f"c{i}") for i in range(len(cols))])  # one row
    parts = centred.mapInArrow(_pair_sums(len(cols)), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy))
    name = lambda i: F.get(F.array(*[F.lit(c) for c in cols]), F.col(i))
    pair = lambda a, b: F.struct(name(a).alias("var_a"), name(b).alias("var_b"))
    return (s.select(F.explode(F.array_distinct(F.array(pair("i", "j"), pair("j", "i")))).alias("_o"), corr.alias("corr"))
            .select("_o.var_a", "_o.var_b", "corr"))


def correlated_drops(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The columns to drop so that no two that stay reach the threshold: a greedy cover, which
    takes the column with the most strong partners left (ties: the first by name) until none is left.
    A row per step: step, column, n_partners.  It folds the strong pairs of columns, whose number
    the schema bounds, in one row."""
    strong = correlated_pairs(corr, threshold).agg(F.collect_list(F.struct(F.col("var_a").alias("a"), F.col("var_b").alias("b"))).alias("_pairs"))
    nothing = F.array().cast("array<struct<column:string,n_partners:bigint>>")

    def take(state, _):
        gone = F.transform(state, lambda t: t["column"])
        left = F.filter("_pairs", lambda p: ~F.array_contains(gone, p["a"]) & ~F.array_contains(gone, p["b"]))
        ends = F.concat(F.transform(left, lambda p: p["a"]), F.transform(left, lambda p: p["b"]))
        best = F.array_min(F.transform(F.array_distinct(ends), lambda c: F.struct((-F.size(F.filter(ends, lambda e: e == c))).alias("m"), c.alias("column"))))
        taken = F.struct(best["column"].alias("column"), (-best["m"]).cast("long").alias("n_partners"))
        return F.when(F.size(left) == 0, state).otherwise(F.concat(state, F.array(taken)))

    folded = strong.where(F.size("_pairs") > 0).select(F.aggregate(F.sequence(F.lit(1), F.size("_pairs")), nothing, take).alias("_d"))
    return folded.select(F.posexplode("_d").alias("_s", "_t")).select((F.col("_s") + 1).cast("long").alias("step"), "_t.column", "_t.n_partners")


def correlated_pairs(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a < b) whose |corr| reaches the threshold — the candidates
    for pruning one of the two."""
    return corr.where((F.col("var_a") < F.col("var_b")) & (F.abs("corr") >= threshold))


def levene_w(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """Levene's W (centre = group mean) per variable, with its degrees of
    freedom.  Two aggregation passes: group means, then absolute deviations.

    W = (N-k)/(k-1) * sum_i n_i (zbar_i - zbar)^2 / sum_ij (z_ij - zbar_i)^2
    with z_ij = |x_ij - mean_i|.  The inner sum uses
    sum (z - zbar_i)^2 = sum z^2 - n_i zbar_i^2 so it needs no third pass.
    """
    lf = long_form(df, [group_col], cols).where(F.col("valor").isNotNull())
    means = lf.groupBy("variable", group_col).agg(F.avg("valor").alias("_mean"))
    z = lf.join(means, ["variable", group_col]).withColumn("_z", F.abs(F.col("valor") - F.col("_mean")))
    g = z.groupBy("variable", group_col).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_z").alias("_sz"), F.sum(F.col("_z") * F.col("_z")).alias("_szz"))
    per_var = g.groupBy("variable").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("_sz").alias("_sz"),
        F.sum(F.col("_sz") * F.col("_sz") / F.col("_n")).alias("_between_raw"),
        F.sum("_szz").alias("_szz"))
    zbar = F.col("_sz") / F.col("n")
    between = F.col("_between_raw") - F.col("n") * zbar * zbar
    within = F.col("_szz") - F.col("_between_raw")
    return per_var.select(
        "variable",
        ((F.col("n") - F.col("k")) / (F.col("k") - 1) * F.try_divide(between, within)).alias("w"),
        (F.col("k") - 1).alias("df1"),
        (F.col("n") - F.col("k")).alias("df2"),
    )


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < eps:
            return h
    raise ArithmeticError(f"incomplete beta function of {a}, {b}, {x}: no convergence")


def _beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def f_survival(w: float, d1: float, d2: float) -> float:
    """P(F > w) for an F(d1, d2) variable."""
    if w is None or not (w == w) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if w <= 0:
        return 1.0
    return _beta_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * w))


def levene_test(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """A19 with the p-value: W, df1, df2 from ``levene_w`` and P(F > W),
    computed by a vectorised UDF on the result rows (one per variable)."""
    @F.pandas_udf("double")
    def p_value(w: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([f_survival(a, float(b), float(c)) for a, b, c in zip(w, d1, d2)])

    lw = levene_w(df, group_col, cols)
    return lw.withColumn("p_value", p_value("w", "df1", "df2"))


def acf(df: DataFrame, series_key: str, order_col: str, cols: Sequence[str], nlags: int) -> DataFrame:
    """Autocorrelation per series and variable, lags 1..nlags.

    acf_k = sum_t (x_t - m)(x_{t+k} - m) / sum_t (x_t - m)^2 over the series'
    rows in order (divisor n on both sides, i.e. statsmodels' default).  One
    window sort per series computes the mean and the ``nlags`` leads; their
    products are summed as columns on the same partitioning, and only the sums
    are unpivoted to a row per lag.  A series is
    one station's daily values, so a window partition is bounded by the
    calendar, not by the data volume.
    """
    lf = long_form(df, [series_key, order_col], cols).where(F.col("valor").isNotNull())
    w_all = Window.partitionBy(series_key, "variable")
    w_ord = w_all.orderBy(order_col)
    centred = lf.withColumn("_x", F.col("valor") - F.avg("valor").over(w_all))
    leads = centred.select(series_key, "variable", "_x",
                           *[F.lead("_x", k).over(w_ord).alias(f"_l{k}") for k in range(1, nlags + 1)])
    lags = [str(k) for k in range(1, nlags + 1)]
    sums = leads.groupBy(series_key, "variable").agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_c0"),
        *[F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)).alias(k) for k in lags]).where(F.col("_c0") > 0)
    return (sums.unpivot([series_key, "variable", "_c0"], lags, "lag", "_c")
            .select(series_key, "variable", F.col("lag").cast("long").alias("lag"),
                    (F.col("_c") / F.col("_c0")).alias("acf")))


def pacf(acf_rows: DataFrame, series_key: str) -> DataFrame:
    """Partial autocorrelation from the ACF rows of each series and variable.

    The Durbin–Levinson recursion as a fold over the array of a series' autocorrelations (``nlags``
    numbers): phi holds the coefficients of the last order, v the share of variance they leave.
    Once nothing is left, the further values are NaN.
    """
    nothing = F.array().cast("array<double>")
    start = F.struct(F.lit(1.0).alias("v"), nothing.alias("phi"), nothing.alias("out"))

    def order(state, k):
        known = F.zip_with(state["phi"], F.reverse(F.slice("_r", 1, k - 1)), lambda p, r: p * r)
        rest = F.get("_r", k - 1) - F.aggregate(known, F.lit(0.0), lambda t, x: t + x)
        value = F.when(state["v"] <= 0, F.lit(float("nan"))).otherwise(F.try_divide(rest, state["v"]))
        # a transform of one element names the value, else each use would compute it again
        return F.get(F.transform(F.array(value), lambda a: F.struct(
            (state["v"] * (1 - a * a)).alias("v"),
            F.concat(F.zip_with(state["phi"], F.reverse(state["phi"]), lambda p, q: p - a * q), F.array(a)).alias("phi"),
            F.concat(state["out"], F.array(a)).alias("out"))), F.lit(0))

    series = acf_rows.groupBy(series_key, "variable").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_acf"))
    series = series.withColumn("_r", F.transform("_acf", lambda x: x["acf"].cast("double")))
    found = series.withColumn("_p", F.aggregate(F.sequence(F.lit(1), F.size("_r")), start, order, lambda state: state["out"]))
    return (found.select(series_key, "variable", F.explode(F.arrays_zip(F.transform("_acf", lambda x: x["lag"]).alias("lag"), F.col("_p").alias("pacf"))).alias("_o"))
            .select(series_key, "variable", F.col("_o.lag").alias("lag"), F.col("_o.pacf").alias("pacf")))
