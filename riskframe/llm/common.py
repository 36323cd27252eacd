"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back: cuts the lineage
    there, so a lost executor costs a re-read and not a recomputation."""
    path = f"{scratch(df.sparkSession)}/llm-{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed_input(docs: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns under the operator's own names, so that extra columns
    of the caller, whatever they are called, never clash.  ``cols`` maps own name to the
    caller's column."""
    return docs.select([docs[f"`{src}`"].alias(own) for own, src in cols.items()])


def text_key(text) -> F.Column:
    """128-bit key of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, width)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]
