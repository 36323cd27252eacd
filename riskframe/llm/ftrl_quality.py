"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed_input
from .labelled import fit, training_rows
from .linear_features import text_terms

BITS = 18
NGRAM = 2
#: Labelled rows used for training, about, at most.
MAX_TRAINING_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1.0
THRESHOLD = 0.7


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after follow-the-regularised-leader (proximal) passes over sparse examples
    (indices, values); the last weight is the bias, which is not shrunk."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        shrink = np.where(i == size, 0.0, l1)
        free = np.sign(z[i]) * np.maximum(np.abs(z[i]) - shrink, 0.0)
        return -free / ((beta + np.sqrt(n[i])) / alpha + np.where(i == size, 0.0, l2))

    for _ in range(epochs):
        for (i, x), target in zip(examples, y):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - target) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def _examples(col, bits: int, ngram: int):
    """(indices, values) of each text: counts over the root of the number of terms, and a bias."""
    bias = 1 << bits
    for _, count, index, who in text_terms(col, bits, ngram):
        order = np.argsort(who, kind="stable")
        index, cut = index[order], np.searchsorted(who[order], np.arange(count + 1))
        for t in range(count):
            i, c = np.unique(index[cut[t]: cut[t + 1]], return_counts=True)
            yield np.append(i, bias), np.append(c / np.sqrt(max(1, c.sum())), 1.0)


def _train(bits: int, ngram: int, epochs: int):
    def run(texts, y) -> bytes:
        return ftrl(list(_examples(texts, bits, ngram)), y, 1 << bits, epochs).astype(np.float32).tobytes()
    return run


def _score(model, bits: int, ngram: int):
    def run(batches):
        w = np.frombuffer(model.value, np.float32).astype(np.float64)
        for batch in batches:
            logit = np.full(batch.num_rows, w[-1])
            for first, count, index, who in text_terms(batch.column("text"), bits, ngram):
                terms = np.maximum(1, np.bincount(who, minlength=count))
                logit[first: first + count] += np.bincount(who, weights=w[index], minlength=count)[:count] / np.sqrt(terms[:count])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=["id", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", usable=None,
                   max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS, ngram: int = NGRAM, epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: the id and score, the probability of label 1.

    Trained on labelled documents for which ``usable(id)`` holds, a sample by hash of about
    ``max_rows``; inputs of a score are the text's words only.  Every text is scored whole.

    Defined cases: a null or empty text has the bias only; labels that are null are not used, of
    several labels of an id the largest counts; without training rows every score is 0.5; an empty
    table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, id_col, text_col, usable or (lambda i: F.lit(True)), max_rows)
    model = fit(rows, _train(bits, ngram, epochs)) or np.zeros((1 << bits) + 1, np.float32).tobytes()
    base = renamed_input(docs, id=id_col, text=text_col)
    out = base.mapInArrow(_score(spark.sparkContext.broadcast(model), bits, ngram), f"id {dict(base.dtypes)['id']}, score double")
    return out.withColumnRenamed("id", id_col)

