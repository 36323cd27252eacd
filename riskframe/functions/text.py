"""Scalar column functions for cleaning landed text.

All of them return native ``Column`` expressions, so they stay inside
whole-stage codegen; none is a Python UDF.  ANSI mode is on, hence the
``try_*`` forms wherever dirty text can reach a cast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that stands for "no value" in the landed files
# (':' in the slope table, 'nan' from string-typed pandas frames, '-' in the
# vulnerability column before it is mapped to a category, empty text).
MISSING_TOKENS = (":", "nan", "-", "")

# Date formats tried, in order, when parsing landed date text.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_get(c: Column | str, sep: str, index: int) -> Column:
    """``split(c, sep)[index]``; null (not an error) when out of range."""
    return F.get(F.split(_c(c), re.escape(sep)), index)


def last_path_part(c: Column | str) -> Column:
    """Last component of a ``/`` path."""
    return F.element_at(F.split(_c(c), "/"), -1)


def regex_group(c: Column | str, pattern: str, group: int) -> Column:
    """One regex group ('' when no match, like Spark's regexp_extract)."""
    return F.regexp_extract(_c(c), pattern, group)


def code_prefix(c: Column | str, n: int) -> Column:
    """First ``n`` characters of a code."""
    return F.substring(_c(c), 1, n)


def drop_last_char(c: Column | str) -> Column:
    """Drop the trailing check digit of a code held as text or number."""
    s = _c(c).cast("string")
    return F.substring(s, F.lit(1), F.length(s) - 1)


def normalize_code(c: Column | str, width: int = 6) -> Column:
    """One canonical text form for municipality codes (left zero-padded; longer codes stay whole)."""
    s = F.trim(_c(c).cast("string"))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def concat_codes(*cols: Column | str) -> Column:
    """C4: province code + municipality code."""
    return F.concat(*[_c(c).cast("string") for c in cols])


def first_available(*cols: Column | str, strict: bool = False) -> Column:
    """First non-null of several sensors, in the stated sensor order.

    ``strict=True`` returns null when two or more sensors report on the same
    day (the reference's text concatenation turns that case into an invalid
    number, quirk Q1).
    """
    cs = [_c(c) for c in cols]
    value = F.coalesce(*cs)
    if not strict:
        return value
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(present <= 1, value)


def to_number(c: Column | str, missing: Iterable[str] = MISSING_TOKENS) -> Column:
    """Decimal-comma text -> double; placeholder text -> null."""
    s = F.trim(_c(c).cast("string"))
    is_missing = F.lower(s).isin(list(missing))
    return F.when(~is_missing, F.regexp_replace(s, ",", ".").try_cast("double"))


def parse_date(c: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Text -> date trying several formats; null when none fits."""
    s = _c(c).cast("string")
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def date_text(c: Column | str) -> Column:
    """Date -> ``yyyy-MM-dd`` text (the reference keeps dates as text)."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def weekday(c: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(c))


def weekend_flag(weekday_col: Column | str) -> Column:
    """1 when the weekday index is above 4 (Saturday, Sunday)."""
    return (_c(weekday_col) > 4).cast("int")


def add_calendar(df: DataFrame, date_col: str = "fecha") -> DataFrame:
    """``laborable`` (weekday), ``dayofyear``, ``weekend``, ``mes``."""
    d = F.col(date_col)
    return df.withColumns({
        "laborable": F.weekday(d).cast("long"),
        "dayofyear": F.dayofyear(d).cast("long"),
        "weekend": (F.weekday(d) > 4).cast("long"),
        "mes": F.month(d).cast("long"),
    })


def replace_placeholder(c: Column | str, placeholder: str, replacement: str | None) -> Column:
    """Map one placeholder value to a category or to null."""
    col = _c(c)
    return F.when(col == F.lit(placeholder), F.lit(replacement)).otherwise(col)


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """C11: round half up on the value's decimal text (``2.675 -> 2.68``),
    not on its binary expansion, so every engine agrees on ties."""
    return F.round(_c(c).cast("decimal(38,10)"), digits).cast("double")


def round_all(df: DataFrame, digits: int = 2) -> DataFrame:
    """C11: round every floating column."""
    return df.withColumns({
        f.name: round_half_up(F.col(f.name), digits)
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls -> the column mean.  The means are one aggregate row,
    joined to every row as a broadcast single-row relation."""
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    return (df.crossJoin(F.broadcast(means))
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in cols})
            .drop(*[f"_mean_{c}" for c in cols]))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Constant fill."""
    return df.na.fill(0, subset=cols)


def clean_name(c: Column | str, suffix: str, sep: str = ",") -> Column:
    """Text before the first separator, then a fixed suffix."""
    return F.concat(F.get(F.split(_c(c), re.escape(sep)), 0), F.lit(suffix))


def array_features(*cols: Column | str) -> Column:
    """Fixed-order feature array (the 'sequence' fed to a model)."""
    return F.array(*[_c(c).cast("double") for c in cols])
