"""Windows and time series.

Every window is partitioned by the series key (station, zone): a partition is
one station's days, bounded by the calendar.  Nothing orders the whole table
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "total_") -> DataFrame:
    """W1 (window form): partition totals attached to every row."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f"{prefix}{c}": F.sum(c).over(w) for c in cols})


def group_totals(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "total_") -> DataFrame:
    """W1 (intended form): one row per key with the totals — a partial
    aggregate, unlike window-then-deduplicate."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"{prefix}{c}") for c in cols])


def rank_first(df: DataFrame, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per partition under a total order — the rows
    ``row_number() = 1`` would keep, computed as a partial aggregate (min of
    a struct led by the order) so a hot partition key is combined map-side
    instead of sorted in one task."""
    from .relational import dedup_by_key
    return dedup_by_key(df, list(partition), list(order))


def forward_fill(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Last non-null value so far, within each series."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def backward_fill(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Next non-null value (fills leading nulls), within each series."""
    # descending, so that the frame only grows: a frame to the end is computed anew for each row
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def series_index(df: DataFrame, key: str, order: str) -> DataFrame:
    """One DataFrame of many series: position ``t`` and length per series."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"t": F.row_number().over(w).cast("long"),
                           "n_obs": F.count(F.lit(1)).over(Window.partitionBy(key))})


def daily_spine(df: DataFrame, key: str, date_col: str = "fecha") -> DataFrame:
    """Every calendar day between each series' first and last date, with
    the series' values where present (null elsewhere)."""
    bounds = df.groupBy(key).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    spine = bounds.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date_col))
    return spine.join(df, [key, date_col], "left")


def station_trend(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """The ordered per-station series behind a trend plot."""
    return df.select(key, order, *cols).orderBy(key, order)
