"""Whitening of embeddings with the exact characteristic polynomial of their integer scatter.

Vectors become integers.  The scatter n * sum(y y') - T T' of the distinct ones (y: centred by a whole
number, T: their sum) is an integer matrix A, n^2 times the covariance.  Only A, d x d numbers, and
the polynomial, d + 1 numbers, are ever gathered.

1. **Polynomial.**  Modulo many primes A is brought to Hessenberg form and its characteristic
   polynomial read off; primes are spread over the executors and joined by Chinese remaindering.
2. **Roots.**  All roots are real, so the sign changes of the polynomial shifted by x count the
   roots above x exactly (Descartes).  Intervals are halved until a root is alone, or a cluster of
   equal ones can't be told apart, and then to far beyond double precision.
3. **Components.**  Inverse iteration in whole-number arithmetic on A - e I, whose null space
   holds the component; a root of multiplicity m gets m orthogonal ones.  One task a component.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed_input, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows that a task turns into one matrix product at a time.
_ROWS = 4096
#: Bits after the point of roots, and of the arithmetic on components.
_ROOT_BITS, _BITS = 160, 320
#: Vectors are split in limbs of so many bits: sums of _ROWS products are exact as doubles.
_LIMB = 20


# --- polynomial -------------------------------------------------------------------------------

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2^31), found by sieving downwards."""
    found: list[int] = []
    small = [p for p in range(2, math.isqrt(top) + 1) if all(p % r for r in range(2, math.isqrt(p) + 1))]
    while len(found) < count:
        base = max(2, top - 20_000)
        alive = np.ones(top - base, bool)
        for p in small:
            alive[max(p * p, -(-base // p) * p) - base:: p] = False
        found += (np.flatnonzero(alive) + base)[::-1].tolist()
        top = base
    return found[:count]


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - a) modulo the prime p < 2^31, from x^0 to x^d.

    Similarity steps bring ``a`` to upper Hessenberg form; the polynomials of its leading blocks
    then follow from each other.
    """
    h, d = a % p, len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        for k in np.flatnonzero(u):  # the inverse step on the columns
            h[:, m] = (h[:, m] + int(u[k]) * h[:, m + 1 + int(k)]) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)
    blocks[0, 0] = 1
    for m in range(1, d + 1):
        new = np.concatenate([[0], blocks[m - 1, :-1]]) - int(h[m - 1, m - 1]) * blocks[m - 1] % p
        t = 1
        for i in range(1, m):
            t = t * int(h[m - i, m - i - 1]) % p
            new = (new - (t * int(h[m - i - 1, m - 1]) % p) * blocks[m - i - 1]) % p
        blocks[m] = new % p
    return blocks[d].tolist()


def primes_needed(a: np.ndarray) -> int:
    """So many primes near 2^31 that their product is more than twice any coefficient: the roots
    are not negative and sum to the trace, so the k-th coefficient is at most C(d, k) (trace/d)^k."""
    d, trace = len(a), int(sum(a[i, i] for i in range(len(a))))
    bits = max((math.comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1))
    return (bits + 2) // 30 + 1


def joined_residues(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Chinese remaindering of each coefficient, to the number nearest to 0."""
    whole = math.prod(primes)
    parts = [whole // p for p in primes]
    weights = [q * pow(q, -1, p) for q, p in zip(parts, primes)]
    out = []
    for column in zip(*residues):
        c = sum(r * w for r, w in zip(column, weights)) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


# --- roots ------------------------------------------------------------------------------------

def roots_above(poly: list[int], x: int, bits: int) -> int:
    """Roots above x / 2^bits of a polynomial with real roots only, each as often as it occurs."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]  # the roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += x * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def _sign(poly: list[int], x: int, bits: int) -> int:
    v = 0
    for k, c in enumerate(reversed(poly)):
        v = v * x + (c << (bits * k))
    return (v > 0) - (v < 0)


class Root(NamedTuple):
    """The k-th largest root is value / 2^_ROOT_BITS; it is one of ``size`` equal ones, which are
    the first-th and the following."""
    value: int
    first: int
    size: int


def kth_root(poly: list[int], k: int, top: int) -> Root:
    """The k-th largest root (from 1), not above ``top``, isolated and then halved down."""
    low, high, bits = -1, top + 1, 0  # low / 2^bits < root <= high / 2^bits
    above_low, above_high = len(poly) - 1, 0
    while bits < _ROOT_BITS and above_low - above_high > 1:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        mid = (low + high) // 2
        n = roots_above(poly, mid, bits)
        if n >= k:
            low, above_low = mid, n
        else:
            high, above_high = mid, n
    first, size = above_high + 1, above_low - above_high
    if size == 1:  # alone: one change of sign between the ends
        shift = _ROOT_BITS - bits
        low, high, bits = low << shift, high << shift, _ROOT_BITS
        right = _sign(poly, high, bits)
        if right == 0:
            return Root(high, first, 1)
        while high - low > 1:
            mid = (low + high) // 2
            s = _sign(poly, mid, bits)
            if s == 0:
                return Root(mid, first, 1)
            low, high = (low, mid) if s == right else (mid, high)
    return Root(high << (_ROOT_BITS - bits), first, size)


# --- components -------------------------------------------------------------------------------

def null_vectors(a: np.ndarray, root: Root) -> list[np.ndarray]:
    """Orthogonal unit vectors of the null space of a - root I, as doubles, by inverse iteration."""
    d, one = len(a), 1 << _BITS
    m = np.array([[int(v) << _BITS for v in row] for row in a], object)
    for i in range(d):
        m[i, i] -= root.value << (_BITS - _ROOT_BITS)
    order = list(range(d))
    for c in range(d):  # elimination with the largest pivot; multipliers stay below the diagonal
        at = c + max(range(d - c), key=lambda i: abs(m[c + i, c]))
        if at != c:
            m[[c, at]] = m[[at, c]]
            order[c], order[at] = order[at], order[c]
        if m[c, c] == 0:
            m[c, c] = 1  # the smallest number there is stands for the zero of a singular matrix
        for i in range(c + 1, d):
            f = (m[i, c] << _BITS) // m[c, c]
            m[i, c] = f
            if f:
                m[i, c + 1:] -= (f * m[c, c + 1:]) >> _BITS
    rng = np.random.default_rng(d)
    found: list[np.ndarray] = []
    for _ in range(root.size):
        v = np.array([int(x) * (one >> 20) for x in rng.integers(1 << 18, 1 << 20, d)], object)
        for _ in range(3):
            v = v[order]
            for i in range(1, d):
                v[i] -= int(m[i, :i] @ v[:i]) >> _BITS
            for i in range(d - 1, -1, -1):
                v[i] = ((v[i] - (int(m[i, i + 1:] @ v[i + 1:]) >> _BITS if i + 1 < d else 0)) << _BITS) // m[i, i]
            v = _unit(v, found)
        found.append(v)
    return [np.array([float(math.ldexp(int(x) >> (_BITS - 80), -80)) for x in v]) for v in found]


def _unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """v without its share of the other unit vectors, with length one."""
    size = max(abs(int(x)) for x in v).bit_length()
    v = np.array([int(x) << (_BITS - size) if size <= _BITS else int(x) >> (size - _BITS) for x in v], object)
    for u in [*others, *others]:
        v = v - ((int(u @ v) >> _BITS) * u >> _BITS)
    length = math.isqrt(int(v @ v))
    return np.array([(int(x) << _BITS) // length for x in v], object)


# --- the operator -----------------------------------------------------------------------------

class Whitening(NamedTuple):
    """n distinct vectors with sums S; per component the unit vector, its eigenvalue, its share of
    the trace; identity_error as measured over the distinct vectors."""
    n: int
    sums: list[int]
    vectors: list[list[float]]
    values: list[float]
    explained: list[float]
    identity_error: float


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array of long) of the usable rows."""
    base = renamed_input(rows, id=id_col, v=vector_col).filter("v is not null")
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 50), F.lit(False)))
    base = base.filter(usable)
    return base.select("id", F.transform("v", lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long")).alias("x"))


def _moments(centre: list[int]):
    """Exact sums (row d) and sums of products (rows 0 .. d-1) of a task's centred vectors."""
    d, c = len(centre), np.array(centre, np.int64)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.decimal128(38, 0))])

    def run(batches):
        total = np.zeros((d + 1, d), object)
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for at in range(0, len(flat), _ROWS):
                y = flat[at: at + _ROWS] - c
                total[d] += y.sum(axis=0).astype(object)
                limbs, size = [], np.abs(y)
                while size.any():
                    limbs.append((np.sign(y) * (size & ((1 << _LIMB) - 1))).astype(float))
                    size >>= _LIMB
                for p, u in enumerate(limbs):
                    for q, v in enumerate(limbs):
                        total[:d] += (u.T @ v).astype(np.int64).astype(object) << (_LIMB * (p + q))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))], schema=schema)
    return run


def scatter_of(distinct: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S per dimension, and the integer matrix n^2 * covariance of x."""
    d = len(distinct.first()["x"])
    head = distinct.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d)]).alias("s")).first()
    n, sums = head["n"], [int(v) for v in head["s"]]
    centre = [s // n for s in sums]
    parts = distinct.mapInArrow(_moments(centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    y = np.zeros((d + 1, d), object)
    for r in parts.collect():  # (d + 1) x d numbers, whatever the rows
        y[r["i"], r["j"]] = int(r["v"])
    t = y[d]
    return n, sums, n * y[:d] - np.outer(t, t)


def polynomial_of(a: np.ndarray, spark) -> list[int]:
    """The exact characteristic polynomial of an integer matrix without negative roots."""
    primes = primes_below(1 << 31, primes_needed(a))

    def run(batches):
        for batch in batches:
            got = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([polynomial_mod(np.array(a % p, np.int64), p) for p in got], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), max(2, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    return joined_residues([r["c"] for r in rows], [r["p"] for r in rows])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of x; None without rows or without dimensions."""
    spark = x.sparkSession
    distinct = written(x.select("x").distinct(), "vectors")
    if distinct.isEmpty() or not distinct.first()["x"]:
        return None
    n, sums, a = scatter_of(distinct)
    d, trace = len(sums), int(sum(a[i, i] for i in range(len(sums))))
    poly = polynomial_of(a, spark)
    rank = d - next(k for k, c in enumerate(poly) if c)
    wanted = min(components, rank)
    if not wanted:
        return Whitening(n, sums, [], [], [], 0.0)

    def run(batches):
        for batch in batches:
            for k in batch.column("k").to_pylist():
                root = kth_root(poly, k, trace)
                v = null_vectors(a, root)[k - root.first]
                e = root.value / (1 << _ROOT_BITS)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([e / n / n]), pa.array([e / trace]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["k", "e", "share", "v"])

    found = spark.createDataFrame([(k + 1,) for k in range(wanted)], "k int").repartition(wanted).mapInArrow(run, "k int, e double, share double, v array<double>").collect()
    found.sort(key=lambda r: r["k"])
    model = Whitening(n, sums, [r["v"] for r in found], [r["e"] for r in found], [r["share"] for r in found], 0.0)
    return model._replace(identity_error=_identity_error(distinct, model))


def _projection(model: Whitening):
    """(centre, matrix): (x - centre) * n - rest is whitened by the matrix; all parts are exact but the last product."""
    n, w = model.n, np.array(model.vectors).T / np.sqrt(np.array(model.values))
    centre = np.array([s // n for s in model.sums], np.int64)
    rest = np.array([s % n for s in model.sums], float) / n

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - rest) @ w
    return project


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened distinct vectors' covariance minus the identity, measured."""
    k, d, project = len(model.values), len(model.sums), _projection(model)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = project(batch.column("x").flatten().to_numpy().reshape(-1, d))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = r["v"]
    mean = sums[k] / model.n
    return float(np.abs(sums[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable input row and component (from 1, by falling eigenvalue): the id,
    component, n, deviation, whitened, explained, identity_error.

    x = floor(64 * entry) + 1,000,000 per entry.  The fit uses each distinct x once, n in all, with
    sums S and the covariance of divisor n.  deviation is the exact sum of (n x - S)^2 over the
    dimensions, whitened the projection of x - S / n on the component over the root of its
    eigenvalue, explained the eigenvalue's share of the trace.

    Defined cases: a null vector, one with a null, NaN, infinite entry or one of 2^50 and more, and
    one whose length is not the most common (the longer of equals), gives no row; rows with equal
    vectors or ids, and null ids, each give their rows; there are at most as many components as the
    covariance has eigenvalues above 0, so an empty table, a single distinct vector and vectors without
    entries give none; a deviation beyond 64 bits is null; further columns are not read.
    """
    every = integer_vectors(rows, id_col, vector_col)
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    x = every.filter(F.size("x") == (lengths["d"] if lengths else 0))
    model = fit(x, components)
    out = f"id {dict(every.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.values:
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    n, k, d, project = model.n, len(model.values), len(model.sums), _projection(model)
    centre, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], object)
    explained, error = np.array(model.explained), model.identity_error

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                y = part.column("x").flatten().to_numpy().reshape(-1, d)
                kind = np.int64 if d * ((int(np.abs(y - centre).max()) + 1) * n) ** 2 < 1 << 63 else object
                off = (y - centre).astype(kind) * n - rest.astype(kind)  # n x - S
                deviation = [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]
                w = project(y)
                m = len(y)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return x.mapInArrow(run, out).withColumnRenamed("id", id_col)
