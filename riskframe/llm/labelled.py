"""Labelled training rows: a bounded, repeatable sample handed to one task that fits a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed_input


def checksum(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, usable, most: int) -> DataFrame:
    """text, y of labelled documents for which ``usable(id)`` holds; about ``most`` at most, taken
    by a hash of the id, so that a larger corpus gives a sample of the same size."""
    y = renamed_input(labels, id=id_col, y=label).filter("y is not null").filter(usable(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = y.count()
    if n > most:
        y = y.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return renamed_input(docs, id=id_col, text=text_col).join(y, "id").select("text", "y")


def fit(rows: DataFrame, trainer) -> bytes | None:
    """Run ``trainer(texts as an Arrow column, labels)`` in one task over the bounded sample; the
    model comes back as bytes of a size fixed by its parameters.  None without rows."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array([hash_of(t) for t in table.column("text").to_pylist()], np.uint64), kind="stable")
        table = table.take(pa.array(order))
        return pa.table({"model": pa.array([trainer(table.column("text").combine_chunks(), np.array(table.column("y").to_pylist()))], pa.binary())})

    got = rows.withColumn("_", F.lit(1)).groupBy("_").applyInArrow(lambda t: run(t), "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def hash_of(text: str | None) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
