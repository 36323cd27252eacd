"""One registered query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (exact_whitening, feistel_shard, fm_toxicity, ftrl_quality, host_rules, language_id, order_minhash, periodic_runs, secret_scan, sentence_pieces,
               suffix, template_decontam, url_filter)
from .labelled import checksum

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_array_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates per document; the document with doc_id = class_id stays."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_words")


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages"))


@_query
def op5_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = fm_toxicity.toxicity_scores(docs, labels, usable=lambda i: checksum(i, 3) != 1)
    return _scored(scores, 3, 1, fm_toxicity.THRESHOLD)


@_query
def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


@_query
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark items that they hold."""
    return template_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@_query
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_shard.feistel_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("row")


@_query
def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = ftrl_quality.quality_scores(docs, labels, usable=lambda i: checksum(i, 4) != 2)
    return _scored(scores, 4, 2, ftrl_quality.THRESHOLD)


@_query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *(count(b[0]) for b in secret_scan.BASE), "base_sha256", F.array_join(told, ",").alias("spans"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.rewritten(table(spark, sf_dir, "documents")))
    # the first run of the greatest length / period; the products of two whole numbers are exact
    higher = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda top, r: F.when(higher(r, top), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    out = found.withColumn("top", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


@_query
def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_whitening.whiten(table(spark, sf_dir, "embeddings"))


def _scored(scores: DataFrame, mod: int, part: int, threshold: float) -> DataFrame:
    return scores.select("doc_id", (checksum(F.col("doc_id"), mod) == part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
