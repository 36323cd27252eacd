"""Toxicity: a factorization machine over hashed terms.

Besides a weight, each term has a vector; the products of the vectors of the terms that a text
holds score their pairs, such as an insult next to a group's name, which a sum of single weights
misses.  Terms are hashed words, word shapes, pairs of shapes and repeated words
(``linear_features``); every term of the training sample takes part, also one that is as frequent
under both labels.  A text is its terms, once each, scaled to length 1.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed_input
from .labelled import fit, training_rows
from .linear_features import text_terms

BITS = 20
MAX_TRAINING_ROWS = 20_000
FACTORS = 8
#: Texts that training takes in all its passes, and the bounds on the passes.
STEPS = 60_000
PASSES = (4, 40)
RATE = 0.1
#: On the weights (absolute values) and on the vectors (squares).
L1 = 2.0
L2 = 1e-2
#: One training text in so many is kept for the calibration of the scores.
SLICE = 5
THRESHOLD = 0.7

#: Terms of texts in a row: (term numbers, first place of each text and the end, values).
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def dense_rows(x: np.ndarray) -> Rows:
    """The rows of a matrix as ``Rows``."""
    row, col = np.nonzero(x)
    return col, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]), x[row, col].astype(float)


def _sums(a: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0, dtype=float)])
    return total[off[1:]] - total[off[:-1]]


def _forward(rows: Rows, bias: float, w: np.ndarray, v: np.ndarray):
    index, off, x = rows
    xv = v[index] * x[:, None]
    s = _sums(xv, off)
    return bias + _sums(w[index] * x, off) + 0.5 * ((s * s).sum(1) - _sums((xv * xv).sum(1), off)), s, xv


def fm_scores(x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """bias + sum w x + sum over pairs <v_i, v_j> x_i x_j, in linear time by the square of the sum."""
    return _forward(dense_rows(x), bias, w, v)[0]


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_rows(rows: Rows, y: np.ndarray, d: int, factors: int, epochs: int, rate: float, l1: float, l2: float, batch: int = 64):
    """Bias, weights and vectors of ``d`` terms by the logistic loss; repeatable.  Only the terms of a
    batch are touched.  A weight follows the regularised leader, so that it stays 0 until the evidence
    exceeds ``l1``; a vector takes gradient steps with a rate of its own, which falls as it learns."""
    index, off, x = rows
    rng = np.random.default_rng(1)
    w, z, n = np.zeros(d), np.zeros(d), np.zeros(d)
    v, seen = rng.normal(0, 0.01, (d, factors)), np.full(d, 1e-2)
    bias, bias_seen = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(y), batch):
            some = order[b: b + batch]
            size = off[some + 1] - off[some]
            own = np.repeat(np.arange(len(some)), size)
            ends = np.concatenate([[0], np.cumsum(size)])
            at = off[some][own] + np.arange(len(own)) - ends[own]
            terms, local = np.unique(index[at], return_inverse=True)
            xb = x[at]
            score, s, xv = _forward((local, ends, xb), bias, w[terms], v[terms])
            e = _probability(score) - y[some]
            g = np.bincount(local, e[own] * xb, len(terms))
            z[terms] += g - (np.sqrt(n[terms] + g * g) - np.sqrt(n[terms])) / rate * w[terms]
            n[terms] += g * g
            w[terms] = -np.sign(z[terms]) * np.maximum(np.abs(z[terms]) - l1, 0) * rate / (1 + np.sqrt(n[terms]))
            step = (e[own] * xb)[:, None] * (s[own] - xv)
            gv = np.stack([np.bincount(local, step[:, k], len(terms)) for k in range(factors)], 1) + l2 * v[terms]
            seen[terms] += (gv * gv).mean(1)
            v[terms] -= rate * gv / np.sqrt(seen[terms])[:, None]
            bias_seen += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(bias_seen)
    return bias, w, v


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of scores, so that they are log odds: a logistic fit by Newton steps, halved
    while they do not help; targets are a little inside 0 and 1, so that it ends on separate labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    loss = lambda c: np.logaddexp(0, x @ c).sum() - t @ (x @ c)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        q = _probability(x @ at)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-9 * np.eye(2), x.T @ (q - t))
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() <= 1e-9:
            break
    return (at[0], at[1]) if at[0] > 0 else (1.0, 0.0)


def train_fm(x: np.ndarray, y: np.ndarray, factors: int, epochs: int, rate: float, l2: float, l1: float = 0.0):
    """``train_rows`` over the rows of a matrix."""
    return train_rows(dense_rows(x), y, x.shape[1], factors, epochs, rate, l1, l2)


def _text_rows(col, bits: int):
    """Yields ``Rows`` of blocks of texts: each term once, of value 1 / root of their number."""
    for _, n, index, who in text_terms(col, bits, 1):
        pairs = np.unique(who.astype(np.int64) << bits | index)
        size = np.bincount(pairs >> bits, minlength=n)
        yield (pairs & (1 << bits) - 1).astype(np.int32), np.concatenate([[0], np.cumsum(size)]), np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)


def _taken(rows: Rows, which: np.ndarray) -> Rows:
    """The marked texts of ``rows``."""
    size = np.diff(rows[1])
    of = np.repeat(which, size)
    return rows[0][of], np.concatenate([[0], np.cumsum(size[which])]), rows[2][of]


def _train(bits: int, factors: int, rate: float, l1: float, l2: float):
    def run(texts, y) -> bytes:
        parts = list(_text_rows(texts, bits))
        terms, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        passes = int(np.clip(STEPS // len(y), *PASSES))
        rows, y = (index.astype(np.int32), off, np.concatenate([p[2] for p in parts])), y.astype(float)
        # scores of texts that a first training leaves out tell how far those of new texts reach
        apart = np.arange(len(y)) % SLICE == 0
        slope, shift = 1.0, 0.0
        if 0 < y[apart].sum() < apart.sum() and (~apart).any():
            first = train_rows(_taken(rows, ~apart), y[~apart], len(terms), factors, passes, rate, l1, l2)
            slope, shift = calibration(_forward(_taken(rows, apart), *first)[0], y[apart])
        bias, w, v = train_rows(rows, y, len(terms), factors, passes, rate, l1, l2)
        bias, w, v = slope * bias + shift, slope * w, np.sqrt(slope) * v
        out = io.BytesIO()
        np.savez(out, bias=bias, terms=terms, w=w.astype(np.float32), v=v.astype(np.float32))
        return out.getvalue()
    return run


def _score(model, bits: int):
    def run(batches):
        if model.value is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(batch.num_rows, 0.5))], names=["id", "score"])
            return
        m = np.load(io.BytesIO(model.value))
        # terms that training did not meet are the last, of weight 0
        w, v = (np.concatenate([m[a], np.zeros_like(m[a][:1])]) if len(m["terms"]) else np.zeros((1, *m[a].shape[1:]), np.float32) for a in ("w", "v"))
        slot = np.full(1 << bits, len(w) - 1, np.int32)
        slot[m["terms"]] = np.arange(len(w) - 1)
        for batch in batches:
            z = [_forward((slot[index], off, x), float(m["bias"]), w, v)[0] for index, off, x in _text_rows(batch.column("text"), bits)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_probability(np.concatenate(z)) if z else np.zeros(0))], names=["id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", usable=None,
                    max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS, factors: int = FACTORS) -> DataFrame:
    """One row per input row: the id and score, the probability of label 1.

    Trained on labelled documents for which ``usable(id)`` holds, a sample by hash of about
    ``max_rows``, in more passes the smaller it is; inputs of a score are the text's words only.
    Every text is scored whole.

    Defined cases: a null or empty text has the score of no terms; null labels are not used, of
    several labels of an id the largest counts; without training rows every score is 0.5; an empty
    table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, id_col, text_col, usable or (lambda i: F.lit(True)), max_rows)
    model = fit(rows, _train(bits, factors, RATE, L1, L2))
    base = renamed_input(docs, id=id_col, text=text_col)
    out = base.mapInArrow(_score(spark.sparkContext.broadcast(model), bits), f"id {dict(base.dtypes)['id']}, score double")
    return out.withColumnRenamed("id", id_col)
