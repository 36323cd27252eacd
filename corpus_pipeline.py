"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Counted as part of the subpackage ``riskframe.llm``.  ``STAGES`` lists (name, function); a
function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but
for the last.  Rows are identified by id and text, so repeated ids are no problem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import language_id, order_minhash, sentence_pieces, suffix, template_decontam
from riskframe.llm.common import text_key, written
from riskframe.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an unknown language go; the others, null and empty texts' rows by the same
    rule, stay as they are."""
    return _without(docs, language_id.identify(docs).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays.  Null and empty
    texts are one class; null ids come first."""
    classes = order_minhash.near_duplicates(docs)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_tid").agg(F.min("tid").alias("tid"), F.min("class_id").alias("id"))
    rows = _packed(docs).withColumn("key", text_key(F.col("doc.text")))
    kept = rows.join(first, (F.col("key") == F.col("tid")) & F.col("doc.doc_id").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["tid", "id"]).select("doc.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first of the documents that hold them; a document
    of which nothing is left goes.  Documents that share nothing stay as they are."""
    cut = suffix.without_later_passages(docs).filter("not cut or trim(text) <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return cut.select(*(new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return _without(docs, template_decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that they decode to it."""
    return sentence_pieces.encode(docs)


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column doc, so that names of the caller's columns clash with nothing."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"))


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The documents but those of which ``out`` has the doc_id and row (hash of id and text)."""
    out = out.select(F.col("doc_id").alias("id"), F.col("row").alias("row")).distinct()
    rows = _packed(docs)
    return rows.join(out, (F.xxhash64("doc.doc_id", "doc.text") == F.col("row")) & F.col("doc.doc_id").eqNullSafe(F.col("id")), "left_anti").select("doc.*")


STAGES = [("language_id", identify_language), ("order_minhash", near_duplicates), ("suffix_array", suffix_dedup), ("template_decontamination", decontaminate), ("sentencepiece", encode)]

#: SQL expresses neither the sketches nor the cuts; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
