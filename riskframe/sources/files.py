"""Sources (S1–S9) and sinks (K1–K7).

Readers always take an explicit schema (no inference pass over the data);
writers leave the number of files to the caller, because ``coalesce(1)``
also lowers the parallelism of everything upstream of the write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory
    (``spark.checkpoint.dir``) — never a machine-local temp folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskframe-io/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as parquet under the shared checkpoint
    folder and read it back (one job; survives executor loss)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def all_string_schema(cols: list[str]) -> T.StructType:
    """S3: every column as text (keeps leading zeros of codes)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def load_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
               header: bool = True, rename: dict[str, str] | None = None,
               view: str | None = None, save_as: str | None = None) -> DataFrame:
    """Delimited text with a fixed schema; optional bulk rename,
    temp view and managed-table save (K7)."""
    df = (spark.read.schema(schema).option("header", header).option("sep", sep)
          .option("mode", "PERMISSIVE").csv(path))
    if rename:
        df = df.withColumnsRenamed(rename)
    if view:
        df.createOrReplaceTempView(view)
    if save_as:
        df.write.mode("overwrite").saveAsTable(save_as)
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.parquet(path)


def read_with_provenance(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|",
                         date_pattern: str = r"(\d{4})(\d{2})") -> DataFrame:
    """Many delimited files in one read; the file path (from the
    hidden ``_metadata`` column) gives ``filename``, ``year`` and ``month``
    (regex groups 1 and 2 of ``date_pattern`` over the path)."""
    df = (spark.read.schema(schema).option("header", True).option("sep", sep)
          .option("recursiveFileLookup", True).csv(path))
    fp = F.col("_metadata.file_path")
    return df.select("*", F.element_at(F.split(fp, "/"), -1).alias("filename"),
                     F.regexp_extract(fp, date_pattern, 1).try_cast("int").alias("year"),
                     F.regexp_extract(fp, date_pattern, 2).try_cast("int").alias("month"))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType,
                      as_strings: bool = False) -> DataFrame:
    """JSON-lines records with a fixed schema; ``as_strings`` reproduces
    the landed all-text typing."""
    df = spark.read.schema(schema).json(path)
    if as_strings:
        df = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    return df


def parse_json_column(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """A JSON text column expanded into typed columns."""
    parsed = F.from_json(F.col(column), schema)
    return df.withColumn("_j", parsed).select("*", "_j.*").drop("_j")


# ---------------------------------------------------------------- sinks

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", n_files: int | None = None) -> str:
    """K1/K2/K5."""
    (df.coalesce(n_files) if n_files else df).write.mode(mode).parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, cols: list[str], mode: str = "overwrite",
                      dynamic: bool = True) -> str:
    """K3: Hive-style ``col=value`` folders.  With ``dynamic`` only the
    partitions present in ``df`` are replaced (idempotent re-runs)."""
    w = df.write.mode(mode).partitionBy(*cols)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True,
              n_files: int | None = None, mode: str = "overwrite") -> str:
    """K4/K6: delimited text with header."""
    (df.coalesce(n_files) if n_files else df).write.mode(mode).option("header", header) \
        .option("sep", sep).csv(path)
    return path


def write_csv_partitioned(df: DataFrame, path: str, cols: list[str], sep: str = ";", mode: str = "overwrite") -> str:
    """K6: delimited text with header, a ``col=value`` folder per value of ``cols``."""
    df.write.mode(mode).partitionBy(*cols).option("header", True).option("sep", sep).csv(path)
    return path


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """K7: managed table save / replace."""
    df.write.mode(mode).saveAsTable(name)
