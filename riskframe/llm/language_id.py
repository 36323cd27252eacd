"""Language identification by Bayesian fusion of evidence.

The posterior of a language is proportional to
    P(text | language)^t * P(declared | language) * P(address suffix | language) * prior(host)
with hashed byte trigrams for the text, tempered by t = min(1, T / trigrams) since neighbouring
trigrams are not independent; rates of declared languages and of address suffixes given the
language of the text, and host priors smoothed towards the registered domain's and that towards
the whole table's, all by grouped aggregation.  "und" stands for text of no known language:
its trigrams are those of uniformly random bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed_input, written
from .labelled import fit
from .suffix import _mix, _text_blocks

BITS = 16
MAX_TRAINING_ROWS = 20_000
#: Trigrams that count as independent at most.
TEMPER = 30.0
#: Weight of the wider level's rates, in documents.
PRIOR_DOCS = 50.0
MIN_POSTERIOR = 0.5
#: Documents that must declare a language for it to be known.
MIN_DECLARED = 5
MIX = 0.02
_BLOCK = 1 << 20


def trigrams(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes (A-Z as a-z) within each text, and the text of each."""
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    inside = np.arange(3, len(low) + 1) <= ends[owner[: len(code)]]
    return (_mix(code) & np.uint64((1 << bits) - 1)).astype(np.int64)[inside], owner[: len(code)][inside]


def _blocks(col, bits: int):
    """(text index, trigrams, owners); texts beyond a block are read in overlapping parts."""
    for i, j, data, off in _text_blocks(col, _BLOCK):
        owner = np.repeat(np.arange(j - i), np.diff(off))
        for x in range(0, max(1, len(data)), _BLOCK):
            part = slice(x, x + _BLOCK + 2)
            yield i, *trigrams(data[part], off[1:] - x, owner[part], bits)


def _train(bits: int, languages: list[str]):
    def run(texts, y) -> bytes:
        counts = np.zeros((len(languages), 1 << bits))
        for first, index, owner in _blocks(texts, bits):
            for k in range(len(languages)):
                counts[k] += np.bincount(index[y[first + owner] == k], minlength=1 << bits)
        return counts.astype(np.float32).tobytes()
    return run


def log_rates(counts: np.ndarray, mix: float = MIX) -> np.ndarray:
    """Log rates of the hash values by language and, last, of uniformly random bytes."""
    size = counts.shape[1]
    even = np.full((1, size), 1 / size)
    rates = np.concatenate([(1 - mix) * counts / np.maximum(1, counts.sum(1, keepdims=True)) + mix * even, even])
    return np.log(rates)


def _score(model, bits: int, temper: float):
    def run(batches):
        rates = model.value
        for batch in batches:
            total = np.zeros((batch.num_rows, len(rates)))
            n = np.zeros(batch.num_rows)
            for first, index, owner in _blocks(batch.column("text"), bits):
                if len(owner):
                    rows = int(owner[-1]) + 1
                    n[first: first + rows] += np.bincount(owner, minlength=rows)
                    for k in range(len(rates)):
                        total[first: first + rows, k] += np.bincount(owner, weights=rates[k][index], minlength=rows)
            total *= np.minimum(1.0, temper / np.maximum(1.0, n))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(rates)), pa.array(total.ravel()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n.astype(np.int64)), lists], names=[*names, "n_trigrams", "ll"])
    return run


def address_parts(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host; a host without a dot has neither."""
    low = F.lower(host)
    dotted = low.contains(".")
    return F.when(dotted, F.substring_index(low, ".", -1)), F.when(dotted, F.substring_index(low, ".", -2))


def declared_in(html: Column) -> Column:
    """Language code that a page declares in its html element."""
    code = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(code != "", code)


def _rates(df: DataFrame, value: str, languages: list[str], smooth: float = 1.0) -> DataFrame:
    """log P(value | language) by value, from counts of the text's own language, add-one smoothed;
    a missing value is no evidence."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(*[F.count_if(F.col("guess") == k).alias(f"c{k}") for k in range(len(languages))])
    total = counts.agg(F.count("*").alias("values"), *[F.sum(f"c{k}").alias(f"t{k}") for k in range(len(languages))])
    return counts.crossJoin(F.broadcast(total)).select(value, F.array(*[F.log((F.col(f"c{k}") + smooth) / (F.col(f"t{k}") + smooth * F.col("values"))) for k in range(len(languages))]).alias(f"e_{value}"))


def shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """Share of each language's documents in a sample of ``most``: the rarest first, an equal part of the rest each."""
    out, left = {}, most
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(counts) - i))
        out[k], left = take / n, left - take
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | str | None = "lang", host: Column | str | None = "source",
             languages: list[str] | None = None, max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS, temper: float = TEMPER,
             prior_docs: float = PRIOR_DOCS, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """One row per input row: the id, row (hash of id and text), language, posterior, text_language
    (by the text alone), n_trigrams and kept (a known language with at least ``min_posterior``).

    declared: column or expression of the declared language (:func:`declared_in` for markup);
    host: column or expression of the host.  The text model is counted from declared documents, a
    sample by hash of about ``max_rows``, taken language by language, so that rare ones are whole
    before common ones share the rest; scores, rates and priors cover every row, whole texts.
    languages: those known; by default all that MIN_DECLARED documents declare.

    Defined cases: a null or short text is judged by the other evidence; a null or unknown
    declaration, a null host or one without a dot adds nothing; ties go to the first language in
    alphabetical order; repeated rows are judged alike; without any declared row every text is
    "und"; an empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    pick = lambda c: F.lit(None).cast("string") if c is None else (docs[f"`{c}`"] if isinstance(c, str) else c)
    base = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), F.lower(pick(declared)).alias("declared"), pick(host).alias("host"))
    said = base.filter("declared is not null").groupBy("declared").count()
    said = said.filter(F.col("count") >= MIN_DECLARED) if languages is None else said.filter(F.col("declared").isin(languages))
    found = {r["declared"]: r["count"] for r in said.collect()}
    if languages is None:
        languages = sorted(found)
    share = shares(found, max_rows)
    number = F.array_position(F.array(*[F.lit(x) for x in languages]) if languages else F.array(F.lit("")), F.col("declared")) - 1
    sample = base.withColumn("y", number.cast("int")).filter("y >= 0")
    if any(x < 1 for x in share.values()):
        most = F.get(F.array(*[F.lit(int(1_000_000 * share.get(x, 1.0))) for x in languages]), F.col("y"))
        sample = sample.filter(F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1_000_000)) < most)
    model = fit(sample.select("text", "y"), _train(bits, languages))
    counts = np.frombuffer(model, np.float32).reshape(len(languages), -1).astype(float) if model else np.zeros((0, 1 << bits))
    known = languages + ["und"]
    rates = spark.sparkContext.broadcast(log_rates(counts) if len(counts) else np.full((1, 1 << bits), -np.log(1 << bits)))
    if not len(counts):
        known = ["und"]
    kind = dict(base.dtypes)["id"]
    suffix, domain = address_parts(F.col("host"))
    keyed = base.select("id", F.xxhash64("id", "text").alias("row"), "text", "declared", "host", suffix.alias("suffix"), domain.alias("domain"))
    ll = written(keyed.mapInArrow(_score(rates, bits, temper), f"id {kind}, row long, declared string, host string, suffix string, domain string, n_trigrams long, ll array<double>"), "language")
    best = F.array_position("ll", F.array_max("ll")) - 1
    ll = ll.withColumn("guess", F.when(F.col("n_trigrams") > 0, best).otherwise(F.lit(-1)))
    # priors: the whole table, then the registered domain, then the host
    every = ll.agg(F.count("*").alias("n"), *[F.count_if(F.col("guess") == k).alias(f"c{k}") for k in range(len(known))])
    top = every.select(F.array(*[(F.col(f"c{k}") + 1.0) / (F.col("n") + len(known)) for k in range(len(known))]).alias("p"))
    shrunk = lambda counts, wide: F.array(*[(F.col(f"c{k}") + prior_docs * F.get(wide, F.lit(k))) / (F.col("n") + prior_docs) for k in range(len(known))])
    level = lambda *by: ll.filter("host is not null").groupBy(*by).agg(F.count_if(F.col("guess") >= 0).alias("n"), *[F.count_if(F.col("guess") == k).alias(f"c{k}") for k in range(len(known))])
    wide = level("domain").filter("domain is not null").crossJoin(F.broadcast(top)).select("domain", shrunk(None, F.col("p")).alias("dp"))
    hosts = level("host", "domain").join(wide, "domain", "left").crossJoin(F.broadcast(top)).select("host", shrunk(None, F.coalesce("dp", "p")).alias("hp"))
    out = ll.join(_rates(ll, "declared", known), "declared", "left").join(_rates(ll, "suffix", known), "suffix", "left").join(hosts, "host", "left").crossJoin(F.broadcast(top))
    term = lambda k: (F.get("ll", F.lit(k)) + F.coalesce(F.get("e_declared", F.lit(k)), F.lit(0.0)) + F.coalesce(F.get("e_suffix", F.lit(k)), F.lit(0.0)) + F.log(F.get(F.coalesce("hp", "p"), F.lit(k))))
    out = out.withColumn("lp", F.array(*[term(k) for k in range(len(known))])).withColumn("most", F.array_max("lp"))
    out = out.withColumn("mass", F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    names = F.array(*[F.lit(x) for x in known])
    out = out.select("id", "row", F.get(names, (F.array_position("lp", F.col("most")) - 1).cast("int")).alias("language"), F.round(1 / F.col("mass"), 6).alias("posterior"),
                     F.when(F.col("guess") >= 0, F.get(names, F.col("guess").cast("int"))).alias("text_language"), "n_trigrams")
    return out.select(F.col("id").alias(id_col), "row", "language", "posterior", "text_language", "n_trigrams", ((F.col("language") != "und") & (F.col("posterior") >= min_posterior)).alias("kept"))
