"""Feature preparation.

Scaling statistics and category indexes are fitted once on the training rows
and applied to every row (quirks Q14, Q27: one fit, one named feature list).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_time(df: DataFrame, date_col: str, cutoff: str, out: str = "split") -> DataFrame:
    """M6: rows before ``cutoff`` train, the rest test."""
    return df.withColumn(out, F.when(F.col(date_col) < F.lit(cutoff).cast("date"), "train").otherwise("test"))


def standardize(df: DataFrame, cols: Sequence[str], split_col: str = "split", fit_on: str = "train",
                suffix: str = "") -> DataFrame:
    """M7: (x - mean) / population std, both fitted on the training rows
    (the population deviation matches scikit-learn's scaler).  The fitted
    statistics are one row, broadcast to every row."""
    train = df.where(F.col(split_col) == fit_on)
    st = train.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(st))  # single-row statistics
    scaled = {f"{c}{suffix}": F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}"))
              .otherwise(F.lit(0.0)) for c in cols}
    return j.withColumns(scaled).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def one_hot_pipeline(cats: Sequence[str]) -> Pipeline:
    """M8: alphabetical indexes (unseen -> an extra last slot) + full one-hot."""
    stages = []
    for c in cats:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=False))
    return Pipeline(stages=stages)


def one_hot(df: DataFrame, cats: Sequence[str], split_col: str = "split", fit_on: str = "train",
            as_array: bool = True) -> DataFrame:
    """M8: fit once on train, transform all rows; arrays instead of vectors
    when ``as_array`` (plain columns, comparable in SQL)."""
    model = one_hot_pipeline(cats).fit(df.where(F.col(split_col) == fit_on))
    out = model.transform(df)
    if as_array:
        out = out.withColumns({f"{c}_ohe": vector_to_array(f"{c}_ohe") for c in cats})
        out = out.withColumns({f"{c}_idx": F.col(f"{c}_idx").cast("long") for c in cats})
    return out


def assemble_pipeline(numeric: Sequence[str], cats: Sequence[str], calendar: Sequence[str],
                      out: str = "features") -> Pipeline:
    """M9: scaled numeric + one-hot + calendar into one vector (names kept in
    the vector's attribute metadata, used by D7)."""
    stages = one_hot_pipeline(cats).getStages()
    stages.append(VectorAssembler(inputCols=list(numeric) + [f"{c}_ohe" for c in cats] + list(calendar),
                                  outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def subset_rows(df: DataFrame, date_col: str, window: tuple[str, str], mobility_cols: Sequence[str],
                out: str = "subset") -> DataFrame:
    """The rows of the four subsets in one scan, named by ``out``, for one partitioned write.

    A row is in each subset of whose columns none is null; in those without mobility the
    mobility columns are null, so that all four have one schema.  Repeated rows of a subset are
    one row (one shuffle for all four)."""
    lo, hi = (F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    known = lambda cols: F.forall(F.array(*[F.col(f"`{c}`").isNotNull() for c in cols]), lambda x: x)
    every, rest = known(df.columns), known([c for c in df.columns if c not in mobility_cols])
    inside = F.col(date_col).between(lo, hi)
    names = F.array_compact(F.array(F.when(every, "all"), F.when(rest, "sin_movilidad"), F.when(every & inside, "ventana"),
                                    F.when(rest & inside, "ventana_sin_movilidad")))
    rows = df.withColumn(out, F.explode(names))
    return rows.withColumns({c: F.when(~F.col(out).endswith("sin_movilidad"), F.col(c)) for c in mobility_cols}).dropDuplicates()


def analysis_subsets(df: DataFrame, date_col: str, window: tuple[str, str],
                     mobility_cols: Sequence[str]) -> dict[str, DataFrame]:
    """The four analysis views over one table: all, without mobility
    columns, the date window, and the window without mobility."""
    lo, hi = (F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    win = df.where(F.col(date_col).between(lo, hi))
    return {"all": df, "sin_movilidad": df.drop(*mobility_cols),
            "ventana": win, "ventana_sin_movilidad": win.drop(*mobility_cols)}
