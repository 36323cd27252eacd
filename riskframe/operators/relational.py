"""Projections, filters, joins, sorting, de-duplication and unions
(P1–P16, J1–J5, J8, J9, O1–O6, U1).

Every function is ``DataFrame -> DataFrame`` and adds no action.  Join
strategy is left to Catalyst/AQE, which broadcasts from measured sizes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_code


# ---------------------------------------------------------------- projections

def select_qualified(left: DataFrame, right: DataFrame, on: list[tuple[str, str]],
                     right_cols: Mapping[str, str], how: str = "inner") -> DataFrame:
    """``SELECT l.*, r.a AS x, ...`` over an aliased join."""
    cond = None
    for lc, rc in on:
        c = F.col(f"l.{lc}") == F.col(f"r.{rc}")
        cond = c if cond is None else cond & c
    return (left.alias("l").join(right.alias("r"), cond, how)
            .select("l.*", *[F.col(f"r.{src}").alias(dst) for src, dst in right_cols.items()]))


def bulk_rename(df: DataFrame, mapping: Mapping[str, str], keep: Iterable[str] | None = None) -> DataFrame:
    """Rename from a dict, then optionally keep a column list."""
    out = df.withColumnsRenamed(dict(mapping))
    return out.select(*keep) if keep is not None else out


def with_constant(df: DataFrame, name: str, value, dtype: str | None = None) -> DataFrame:
    """Constant or typed-null column (e.g. a source tag)."""
    c = F.lit(value)
    return df.withColumn(name, c.cast(dtype) if dtype else c)


def try_cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast named columns; text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """P5: conform ``df`` to another table's schema (order, types, missing -> null)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- filters

def filter_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """P6."""
    return df.where(F.col(column).isin(list(values)))


def filter_all(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunction of conditions."""
    cond = conditions[0]
    for c in conditions[1:]:
        cond = cond & c
    return df.where(cond)


def filter_nulls(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """P8."""
    return df.where(F.col(column).isNull() if keep_null else F.col(column).isNotNull())


def filter_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """P9."""
    return df.where(F.col(column).contains(text))


def filter_open_ended(df: DataFrame, end_col: str = "data_fi") -> DataFrame:
    """P10: rows still open (no end date).  'nan' text counts as no end date."""
    c = F.col(end_col)
    if isinstance(df.schema[end_col].dataType, T.StringType):
        return df.where(c.isNull() | (F.lower(F.trim(c)).isin("nan", "")))
    return df.where(c.isNull())


def noon_snapshot(df: DataFrame, keys: list[str], ts_col: str = "ts", tie_col: str | None = None,
                  hour: int = 12) -> DataFrame:
    """One reading per key group and day: the one nearest ``hour``:00.

    With regular readings this is exactly the ``12:00:00`` reading; with
    irregular ones it is the closest reading (ties: earlier time, then
    ``tie_col``).  ``max_by``-style aggregation, no full sort.
    """
    day = F.to_date(F.col(ts_col))
    secs = (F.hour(ts_col) * 3600 + F.minute(ts_col) * 60 + F.second(ts_col)).cast("double") + \
        (F.date_format(ts_col, "SSSSSS").cast("double") / 1e6)
    gap = F.abs(secs - F.lit(hour * 3600.0))
    order = [gap.alias("_gap"), F.col(ts_col).alias("_ts")] + ([F.col(tie_col).alias("_tie")] if tie_col else [])
    payload = [c for c in df.columns]
    best = (df.withColumn("_day", day)
            .groupBy(*keys, "_day")
            .agg(F.min(F.struct(*order, F.struct(*[F.col(c) for c in payload]).alias("_row"))).alias("_m")))
    return best.select("_m._row.*")


def filter_date_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Inclusive date range (prunes ``year/month`` partitions when the
    table is partitioned and those columns are derived from the date)."""
    c = F.col(column)
    return df.where(c.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P13."""
    return df.drop(*cols)


def having_count(df: DataFrame, keys: list[str], min_count: int = 2) -> DataFrame:
    """Key groups that occur at least ``min_count`` times (duplicate check)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def occurrence_label(df: DataFrame, area_col: str = "haforestal", out: str = "ocurrencia") -> DataFrame:
    """1 when the burned area is positive; null or 'nan' area -> 0."""
    area = F.col(area_col).try_cast("double")
    return df.withColumn(out, F.when((area > 0) & ~F.isnan(area), 1).otherwise(0).cast("long"))


# The named feature sets of the analysis (13 with mobility,
# 12 without, the 9-column EDA set, 3 categorical, 4 calendar).
FEATURE_SETS = {
    "numeric_mobility": ["prec", "tmax", "tmed", "tmin", "velmedia", "racha", "sol", "presmax",
                         "presmin", "rhum", "altitud", "porcentaje_pendiente_total",
                         "total_viajes_estacion"],
    "numeric": ["prec", "tmax", "tmed", "tmin", "velmedia", "racha", "sol", "presmax",
                "presmin", "rhum", "altitud", "porcentaje_pendiente_total"],
    "eda": ["prec", "tmed", "velmedia", "racha", "sol", "presmax", "rhum", "altitud",
            "porcentaje_pendiente_total"],
    "categorical": ["alto_riesgo", "peligro", "vulner"],
    "calendar": ["laborable", "dayofyear", "weekend", "mes"],
}


def feature_subset(df: DataFrame, sets: Iterable[str], keys: Iterable[str] = (), label: str | None = None) -> DataFrame:
    """Project keys + named feature sets (+ label), keeping set order."""
    cols: list[str] = list(keys)
    for s in sets:
        cols += [c for c in FEATURE_SETS[s] if c not in cols]
    if label:
        cols.append(label)
    return df.select(*cols)


# ---------------------------------------------------------------- joins

def join_keys(left: DataFrame, right: DataFrame, keys: list[str] | list[tuple[str, str]],
              how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys or (left, right) pairs."""
    if keys and isinstance(keys[0], tuple):
        cond = None
        for lc, rc in keys:
            c = left[lc] == right[rc]
            cond = c if cond is None else cond & c
        return left.join(right, cond, how)
    return left.join(right, keys, how)


def count_unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right`` (anti-join)."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def join_normalized(left: DataFrame, right: DataFrame, left_code: str, right_code: str,
                    width: int = 6, right_drop_check_digit: bool = False,
                    how: str = "inner") -> DataFrame:
    """Join codes held as zero-padded text on one side and integers (with
    or without a trailing check digit) on the other."""
    rc = F.col(right_code).cast("string")
    if right_drop_check_digit:
        rc = F.substring(rc, F.lit(1), F.length(rc) - 1)
    r = right.withColumn("_code", normalize_code(rc, width))
    l = left.withColumn("_code", normalize_code(F.col(left_code), width))
    return l.join(r, "_code", how).drop("_code")


def fan_out(station_fact: DataFrame, bridge: DataFrame, station_key: str = "indicativo") -> DataFrame:
    """Copy each station row to every municipality served by the station."""
    return station_fact.join(bridge, station_key, "inner")


# ---------------------------------------------------------------- sort / distinct / sets

def sort_by(df: DataFrame, *cols: str) -> DataFrame:
    """O1: total order (callers pass a unique tie-breaker last)."""
    return df.orderBy(*cols)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """O2: first ``n`` rows of a total order (a top-k report)."""
    return df.orderBy(*order).limit(n)


def distinct_rows(df: DataFrame) -> DataFrame:
    """O3."""
    return df.distinct()


def dedup_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key under an explicit order.

    Written as an aggregate (``min`` of a struct led by the order columns)
    so it is a partial aggregation with map-side combine instead of a window
    that must sort every row of a key in one task (a hot key stays cheap).
    """
    payload = [c for c in df.columns]
    ordered = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return (df.groupBy(*keys)
            .agg(F.min(F.struct(*ordered, F.struct(*[F.col(c) for c in payload]).alias("_row"))).alias("_m"))
            .select("_m._row.*"))


def duplicated_rows(df: DataFrame) -> DataFrame:
    """Every row whose full value occurs more than once, with its multiplicity."""
    cols = df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies"))
            .where(F.col("n_copies") > 1))


def drop_any_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """O6."""
    return df.na.drop("any", subset=subset)


def union_sources(frames: Mapping[str, DataFrame], schema: T.StructType, tag_col: str = "fuente") -> DataFrame:
    """Align each source to one schema (by name, try-cast), tag it, union."""
    out = None
    for tag, df in frames.items():
        part = cast_like(df, schema).withColumn(tag_col, F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out
