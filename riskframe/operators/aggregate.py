"""Aggregations and profiles.

Everything is a grouped aggregate with partial (map-side) aggregation.
Exact quantiles use Spark's ``percentile`` (linear interpolation, the same
definition as pandas' default and DuckDB's ``quantile_cont``); its buffer
holds one entry per *distinct* value of the group, which is small for
rounded measurements and per-station groups.  ``approx=True`` switches to the
bounded-memory ``percentile_approx`` for continuous, high-cardinality data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quantiles(c: Column, ps: Sequence[float], approx: bool, accuracy: int = 10000) -> Column:
    arr = F.array(*[F.lit(p) for p in ps])
    return F.percentile_approx(c, arr, accuracy) if approx else F.percentile(c, arr)


def long_form(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
              name_col: str = "variable", value_col: str = "valor") -> DataFrame:
    """Unpivot ``cols`` into (name, value) rows (all cast to double)."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), name_col, value_col)


# ---------------------------------------------------------------- A1 pivot

def pivot_sum(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence[str],
              value_col: str, names: Sequence[str] | None = None) -> DataFrame:
    """A1: long readings -> one column per listed variable (sum).

    The value list is explicit, so Spark skips the distinct pass over the
    pivot column and plans one two-phase aggregate.
    """
    out = df.groupBy(*keys).pivot(pivot_col, list(values)).agg(F.sum(value_col))
    if names:
        out = out.withColumnsRenamed(dict(zip(values, names)))
    return out


# ---------------------------------------------------------------- A2–A9 counts

def group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """A2: rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def group_nonnull_count(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """A2: pandas-style ``groupby().count()``: non-null count of each column."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])


def group_sum_desc(df: DataFrame, key: str, value: str, out: str = "total") -> DataFrame:
    """A3: sum per group, largest first (ties by key)."""
    return (df.groupBy(key).agg(F.sum(value).alias(out), F.count(F.lit(1)).alias("n"))
            .orderBy(F.col(out).desc(), F.col(key)))


def groups_by_total(df: DataFrame, key: str, value: str, zero: bool = True) -> DataFrame:
    """A4: groups whose total is zero (``zero=True``) or at least one."""
    agg = df.groupBy(key).agg(F.sum(value).alias("total"))
    return agg.where(F.col("total") == 0) if zero else agg.where(F.col("total") >= 1)


def group_max_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: max of every other column per group, each column independently
    (strings compare lexicographically) — the reference's semantics."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def group_max_row(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """A5 (Q26 variant): the whole row holding the largest ``by`` per group."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max(F.struct(F.col(by).alias("_by"), *[F.col(c) for c in others])).alias("_m"))
            .select(*keys, *[F.col(f"_m.{c}").alias(c) for c in others]))


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per named frame with its row count."""
    out = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("tabla"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, single: Sequence[str], pairs: Sequence[tuple[str, str]],
                    approx: bool = False) -> DataFrame:
    """Exact (or approximate) distinct counts of columns and column pairs."""
    def dc(*cols: str) -> Column:
        if approx:
            c = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
            return F.approx_count_distinct(c)
        return F.count_distinct(*[F.col(x) for x in cols])
    aggs = [dc(c).alias(f"n_{c}") for c in single] + [dc(a, b).alias(f"n_{a}_{b}") for a, b in pairs]
    return df.agg(*aggs)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value (nulls excluded, as pandas)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)))


def column_mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value; ties -> the smallest value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("_neg"), F.col(col).alias("_v"))).alias("_m")).select(
        F.col("_m._v").alias("mode"), (-F.col("_m._neg")).alias("n"))


# ---------------------------------------------------------------- A10–A12 profiles

def describe_numeric(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles, max per column (long form).

    Moments come from one aggregation pass; the quartiles are exact order
    statistics found by distributed narrowing (``quantiles.exact_quantiles``),
    or ``percentile_approx`` with ``approx=True``.
    """
    lf = long_form(df, [], cols)
    moments = lf.groupBy("variable").agg(
        F.count("valor").alias("count"), F.avg("valor").alias("mean"), F.stddev_samp("valor").alias("std"),
        F.min("valor").alias("min"), F.max("valor").alias("max"))
    if approx:
        q = lf.groupBy("variable").agg(_quantiles(F.col("valor"), [0.25, 0.5, 0.75], True).alias("_q")).select(
            "variable", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"))
    else:
        from .quantiles import quantile_frame
        q = quantile_frame(lf, "variable", "valor", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return moments.join(F.broadcast(q), "variable", "left").select(
        "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def profile_shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column in one pass, long form (columna, n_null)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "columna", "n_null")


# ---------------------------------------------------------------- A13–A14 quantile fences

def iqr_fences(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: float = 1.5,
               approx: bool = False) -> DataFrame:
    """Quartiles and Tukey fences per (keys, variable)."""
    lf = long_form(df, keys, cols)
    q = lf.groupBy(*keys, "variable").agg(_quantiles(F.col("valor"), [0.25, 0.75], approx).alias("_q"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    return q.select(*keys, "variable", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
                    (F.col("_q")[0] - k * iqr).alias("lower"), (F.col("_q")[1] + k * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, keys: Sequence[str], row_keys: Sequence[str], cols: Sequence[str],
                 k: float = 1.5, inside: bool = False, approx: bool = False) -> DataFrame:
    """Rows strictly outside the fences (or strictly inside with
    ``inside=True``), per group and variable, long form."""
    lf = long_form(df, list(keys) + [c for c in row_keys if c not in keys], cols).where(F.col("valor").isNotNull())
    fences = iqr_fences(df, keys, cols, k, approx)
    j = lf.join(fences, list(keys) + ["variable"])
    v = F.col("valor")
    cond = (v > F.col("lower")) & (v < F.col("upper")) if inside else (v < F.col("lower")) | (v > F.col("upper"))
    return j.where(cond).select(*keys, *[c for c in row_keys if c not in keys], "variable", "valor")


def boxplot_summary(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (), k: float = 1.5,
                    approx: bool = False) -> DataFrame:
    """The numbers behind a box plot: quartiles, whiskers (most extreme
    values inside the fences) and the outlier count.  Without ``group`` the
    quartiles are whole-column order statistics found by distributed
    narrowing; with ``group`` they are per-group ``percentile``."""
    lf = long_form(df, group, cols).where(F.col("valor").isNotNull())
    if group or approx:
        fences = iqr_fences(df, group, cols, k, approx)
        med = lf.groupBy(*group, "variable").agg(
            (F.percentile_approx("valor", 0.5) if approx else F.percentile("valor", 0.5)).alias("median"))
        fences = fences.join(med, list(group) + ["variable"])
    else:
        from .quantiles import quantile_frame
        q = quantile_frame(lf, "variable", "valor", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
        iqr = F.col("q3") - F.col("q1")
        fences = q.select("variable", "q1", "q3", (F.col("q1") - k * iqr).alias("lower"),
                          (F.col("q3") + k * iqr).alias("upper"), "median")
    j = lf.join(F.broadcast(fences) if not group else fences, list(group) + ["variable"])
    v = F.col("valor")
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    return j.groupBy(*group, "variable", "q1", "q3", "lower", "upper", "median").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


# ---------------------------------------------------------------- A15–A16 label profiles

def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, globally or per group, with the share in the group.

    The share's denominator is a window over the already aggregated counts
    (a handful of rows per group), not over the input.
    """
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return c.select(*by, label, "n", (F.col("n") / F.sum("n").over(w)).alias("share"))


def incident_histograms(df: DataFrame, dims: Sequence[str], label: str = "ocurrencia",
                        positive=1) -> DataFrame:
    """Counts of positive rows by each dimension, all dimensions in one
    pass (the rows are expanded once per dimension, then grouped — the same
    plan as GROUPING SETS)."""
    pos = df.where(F.col(label) == positive)
    items = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return (pos.select(F.explode(items).alias("_it")).select("_it.dim", "_it.value")
            .groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n")))


def incidents_by(df: DataFrame, key: str, area: str) -> DataFrame:
    """A3 helper: incident count and burned area per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_incidents"), F.sum(area).alias("ha_total"))


def columns_of(df: DataFrame, kinds: Iterable[str] = ("double", "float", "int", "bigint")) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in set(kinds)]
