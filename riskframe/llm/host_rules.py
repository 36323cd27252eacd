"""Quality rules by document and by host, with DataFrame functions only.

Counts per text come from built-in and array functions, so no word is ever shuffled.  The rule
failures are then counted by host; a host's failure rate is shrunk towards that of all hosts by
a beta prior fitted to the hosts (method of moments), and hosts whose shrunk rate is too high
give their verdict back to all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed_input, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Shrunk failure rate above which a host is rejected.
MAX_HOST_RATE = 0.5
#: Weight limits of the prior, in documents.
PRIOR_DOCS = (1.0, 1000.0)

_GAP = " \t\n\x0b\x0c\r"


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_counts(text: Column) -> dict[str, Column]:
    """The per-document counts of a (non-null) text, by name; words and sorted windows are
    array expressions over one text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _GAP, "") != "")
    return {"words": words, "word_chars": F.length(F.translate(text, _GAP, "")).cast("long"), "n_symbols": _count_of(text, "#*$%&|<>"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}


def _with_repeats(df: DataFrame, window: int) -> DataFrame:
    """n_words and n_repeat_words from the column words: windows are sorted by their hash within
    the text, equal neighbours mark their places, and the marked places cover words."""
    n = F.size("words")
    df = df.withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
    every = F.transform(F.slice("hs", 1, F.greatest(n - (window - 1), F.lit(0))),
                        lambda h, i: F.struct(F.xxhash64(h, *[F.get("hs", i + j) for j in range(1, window)]).alias("h"), i.alias("i")))
    df = df.select(*[c for c in df.columns if c not in ("words", "hs")], n.cast("long").alias("n_words"), F.array_sort(every).alias("ws"))
    near = lambda j: F.coalesce(F.get("ws", j)["h"], F.lit(None))
    hit = F.transform("ws", lambda w, i: F.when((w["h"] == near(i + 1)) | ((i > 0) & (w["h"] == near(F.greatest(i - 1, F.lit(0))))), w["i"]))
    df = df.withColumn("at", F.array_sort(F.filter(hit, lambda x: x.isNotNull()))).drop("ws")
    covered = F.aggregate(F.transform("at", lambda p, j: F.coalesce(F.least(F.lit(window), F.get("at", j + 1) - p), F.lit(window)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered).drop("at")


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS,
                 max_repeat_percent: int = MAX_REPEAT_PERCENT, max_host_rate: float = MAX_HOST_RATE, prior_docs: tuple[float, float] = PRIOR_DOCS) -> DataFrame:
    """One row per input row: the id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, host_rate (shrunk failure rate) and kept.

    Defined cases: a null or empty text has no words and fails; a null host is a host of its own;
    repeated rows count as rows; with one host, or hosts of equal rates, the prior has its largest
    weight; an empty table gives an empty result; further columns are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col, host=host_col).withColumn("text", F.coalesce("text", F.lit("")))
    df = base.select("id", "host", *[c.alias(name) for name, c in text_counts(F.col("text")).items()])
    df = _with_repeats(df, WINDOW)
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
    df = written(df, "counts")  # read by the hosts' rates and by the documents
    # by host, then over the hosts: a few numbers each
    host = df.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed")).alias("f"))
    rate = F.col("f") / F.col("n")
    total = host.agg((F.sum("f") / F.sum("n")).alias("m"), F.sum("n").alias("docs"), F.count("*").alias("hosts"), F.sum(F.col("n") * rate * rate).alias("s2"))
    # between-host variance without the binomial part; weight = m(1-m)/variance - 1
    spread = F.col("s2") / F.col("docs") - F.col("m") * F.col("m")
    noise = F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("docs")
    weight = F.when(spread - noise > 0, F.col("m") * (1 - F.col("m")) / F.nullif(spread - noise, F.lit(0.0)) - 1).otherwise(F.lit(prior_docs[1]))
    total = total.select("m", F.greatest(F.lit(prior_docs[0]), F.least(F.lit(prior_docs[1]), weight)).alias("w"))
    verdict = host.crossJoin(F.broadcast(total)).select("host", ((F.col("f") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))).alias("host_rate"))
    out = df.alias("d").join(verdict.alias("v"), F.col("d.host").eqNullSafe(F.col("v.host")), "left")
    return out.select(F.col("d.id").alias(id_col), F.col("d.host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 9).alias("host_rate"),
                      (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"))
