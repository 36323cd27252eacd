"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. N-1 in the order of (id, text digest).  A keyed Feistel network permutes
the smallest domain of an even number of bits that holds N; values outside 0 .. N-1 are
permuted again until they fall inside, which is a permutation of the row numbers.  The permuted
number p gives shard p mod S and slot p div S: counts differ by one at most, slots are gapless,
and place and row number can be computed from each other without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed_input, text_key, written

SHARDS = 8
SEED = 20
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(1, 1 << 31, rounds)]


def permute(row: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """Feistel permutation of 0 .. n-1 with cycle walking (the inverse with ``back``)."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = row.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        with np.errstate(over="ignore"):
            for k in (reversed(keys) if back else keys):
                if back:
                    left, right = right ^ (_scramble(left, k) & mask), left
                else:
                    left, right = right, left ^ (_scramble(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """Adds row, the gapless number from 0 in the given order.  Rows are range-partitioned and
    sorted where they lie; only one count per partition is gathered."""
    sort = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    before, offset = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()):
        offset.append((r["part"], before - r["first"]))
        before += r["n"]
    steps = df.sparkSession.createDataFrame(offset, "part int, step long")
    return placed.join(F.broadcast(steps), "part").withColumn("row", F.col("at") + F.col("step")).drop("part", "at", "step")


def feistel_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per input row: the id, size (UTF-8 bytes of the text plus 1), text_crc32, row
    (global row number), shard, slot.

    Defined cases: a null text has size 1 and the checksum of no bytes; null ids come first;
    rows with equal id and text are interchangeable, each with a place of its own; an empty table
    gives an empty result; fewer rows than shards leave shards empty; further columns are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    light = base.select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("tid"))
    numbered = row_numbers(light, "id", "tid")
    n = numbered.count()
    keys = round_keys(seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, keys))

    out = numbered.withColumn("p", place("row"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "row", (F.col("p") % shards).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"))
