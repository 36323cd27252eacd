"""Periodic runs of words: stretches that repeat a block of q words at least four times.

Periods are taken octave by octave: D <= q < 2 D with D = 1, 2, 4, ..  Borders stand at every D
words; a stretch of period q and at least 4 q words has a border b such that the 2 D words from
b on come again q words later.

1. **Tiles.**  Per octave a document is laid out in overlapping tiles.  Fingerprints of 2 D words,
   made by doubling, say which borders can lie in a run at all; tiles without one are not kept.
2. **Solving.**  A tile is solved alone, on any executor: at each marked border the Z-function of the words
   after it, and that of the words before it read backwards, give for all periods of the octave
   at once how far the stretch goes to both sides.  A block that is itself a power has a smaller
   period, of a lower octave, and is left out.
3. **Stitching.**  Fragments are shuffled by document and period; two that share q words are one
   stretch.  Tiles overlap so far that the fragments of one run always do.

A border's view is 4 D words to the left and 8 D to the right (more in small octaves), so each
fragment of a run is 4 q words long itself and nothing else is ever sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import byte_view, renamed_input, written

#: Runs repeat their block so many times at least, and have so many words.
LEAST_POWERS, LEAST_WORDS = 4, 6
#: Words of a tile between its margins, or 16 of the octave's D if that is more.
TILE_WORDS = 4096
#: Bytes of tiles that are sent on together.
_FLUSH = 4 << 20


def margins(d: int) -> tuple[int, int]:
    """Words that a border of octave ``d`` looks at to its left and to its right."""
    return max(4 * d, 16), max(8 * d, 64)


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words, equal for equal words of this document only."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def marked_borders(ids: np.ndarray):
    """Per octave (D, borders at which 2 D words come again D to 2 D - 1 words later).

    Fingerprints of 2 D words are made from those of D words; equal words have equal
    fingerprints, so a border of a run is never left out; one too many costs time only.
    """
    d, h = 1, _mixed(ids.astype(np.uint64))
    while len(ids) >= LEAST_POWERS * d:
        with np.errstate(over="ignore"):
            two = _mixed(h[:-d] * np.uint64(0x9E3779B97F4A7C15) + h[d:])  # of the 2 D words from each place on
        borders = np.arange(0, len(two) - d, d)
        full = max(0, len(two) // d - 1)  # borders that see all periods: what follows them lies in rows of D
        hit = np.zeros(len(borders), bool)
        hit[:full] = (two[d: d + full * d].reshape(full, d) == two[borders[:full], None]).any(axis=1)
        for i in range(full, len(borders)):
            hit[i] = (two[borders[i] + d:] == two[borders[i]]).any()
        if hit.any():
            yield d, borders[hit]
        d, h = 2 * d, two


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tiles(ids: np.ndarray):
    """(D, first word, words, marked borders within them) of the tiles that hold a marked border."""
    for d, at in marked_borders(ids):
        left, right = margins(d)
        core = max(TILE_WORDS, 16 * d)
        for t in np.unique(at // core):
            own = at[np.searchsorted(at, t * core): np.searchsorted(at, (t + 1) * core)]
            lo = max(0, int(t) * core - left)
            yield d, lo, ids[lo: (int(t) + 1) * core + right], own - lo


def z_function(s: list[int]) -> list[int]:
    """Length of the common prefix of s with each of its suffixes; at 0 all of it."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve(ids: np.ndarray, d: int, borders) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the stretches of at least four periods seen from the borders."""
    left, right = margins(d)
    words = ids.tolist()
    out: dict[int, list[list[int]]] = {}
    known = 0
    for b in borders:
        # a stretch that goes on so far leaves no room for another period of this octave at b, and
        # its last border, from which its end is seen, is not passed over
        if b + 6 * d <= known:
            continue
        after = z_function(words[b: b + right])
        periods = [q for q in range(d, min(2 * d, len(after))) if after[q] >= 2 * d]
        periods = [q for q in periods if not any(after[q // r] >= q - q // r for r in _prime_factors(q))]
        if not periods:
            continue
        # backwards: the words before b, and those before b + 2 D, among which those before b + q
        # start 2 D - q later
        before = words[max(0, b - left): b][::-1]
        back = z_function([*before, -1, *words[b: b + 2 * d][::-1], *before])
        for q in periods:
            begin, end = b - back[len(before) + 1 + 2 * d - q], b + q + after[q]
            if end - begin < LEAST_POWERS * q:
                continue
            known = max(known, end)
            mine = out.setdefault(q, [])
            if mine and begin <= mine[-1][1] - q:
                mine[-1][1] = max(mine[-1][1], end)
            else:
                mine.append([begin, end])
    return [(q, b, e) for q, parts in out.items() for b, e in parts]


def _prime_factors(q: int) -> list[int]:
    found, r = [], 2
    while r * r <= q:
        if q % r == 0:
            found.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return found + [q] * (q > 1)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_RUNS = "array<struct<start: long, length: long, period: long>>"


def _lay_out(schema: pa.Schema, with_text: bool):
    """A row per document, with its text if it has a tile, else its digest, and a row per tile."""
    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def tile_rows(found: list[tuple]) -> pa.RecordBatch:
        row, octave, first, borders, words = zip(*found)
        return rows({"row": pa.array(row), "octave": pa.array(octave), "first": pa.array(first), "borders": pa.array(borders, pa.list_(pa.int32())), "words": pa.array(words, pa.binary())})

    def run(batches):
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            numbers, counts, sha, found, size = batch.column("row").to_pylist(), [], [], [], 0
            for i in range(batch.num_rows):
                words = data[off[i]: off[i + 1]].tobytes().split()  # at the six ASCII blanks
                searched = with_text
                for d, lo, part, own in tiles(word_ids(words)):
                    searched = True
                    found.append((numbers[i], d, lo, own.tolist(), part.tobytes()))
                    size += 8 * len(part)
                    if size > _FLUSH:
                        yield tile_rows(found)
                        found, size = [], 0
                counts.append(len(words))
                sha.append(None if searched else _digest(words))
            if found:
                yield tile_rows(found)
            sha = pa.array(sha, pa.string())
            texts = pc.if_else(sha.is_null(), batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield rows({"row": batch.column("row"), "id": batch.column("id"), "n": pa.array(counts), "sha": sha, "text": texts})
    return run


def _solve_tiles(batches):
    schema = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])
    for batch in batches:
        for row, d, first, borders, words in zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "first", "borders", "words"))):
            found = [(row, q, first + b, first + e) for q, b, e in solve(np.frombuffer(words, np.int32), d, borders)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)


def _stitched(parts: DataFrame) -> DataFrame:
    """Fragments of one document and period that share a period's words, put together."""
    w = Window.partitionBy("row", "period").orderBy("b", "e")
    far = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col("b") > far - F.col("period")), 1).otherwise(0)
    groups = parts.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("row", "period", "g").agg(F.min("b").alias("start"), F.max("e").alias("e"))
    return whole.select("row", "start", (F.col("e") - F.col("start")).alias("length"), "period").filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_POWERS * F.col("period")))


def _collapse(names: list[str], with_text: bool):
    def run(batches):
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            sha, kept = [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                words = data[off[i]: off[i + 1]].tobytes().split()
                keep = np.ones(len(words), bool)
                for r in runs or ():
                    keep[r["start"] + r["period"]: r["start"] + r["length"]] = False
                left = [words[j] for j in np.flatnonzero(keep).tolist()]
                sha.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("runs"), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * with_text, names=names)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: the id, n_words, runs (array of start, length, period, by start and
    then period), collapsed_sha256 of the words outside every run's repeats, joined by one space,
    and with ``keep_text`` those words as collapsed_text.

    Words are what stands between ASCII blanks.  A run is a stretch of words with smallest period
    q, at least 4 q and 6 words long, that no neighbour extends; of a run its first q words stay.

    Defined cases: a null, empty or blank text has no words, no runs and the digest of nothing;
    null and repeated ids, and equal rows, each give a row of their own; a very long text is solved
    tile by tile on many executors; an empty table gives an empty result; further columns are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = dict(base.dtypes)["id"]
    laid_out = StructType.fromDDL(f"row long, id {kind}, n long, sha string, text string, octave int, first long, borders array<int>, words binary")
    laid = written(base.mapInArrow(_lay_out(to_arrow_schema(laid_out), keep_text), laid_out), "tiles")
    pieces = laid.filter("octave is not null").select("row", "octave", "first", "borders", "words").repartition("row", "octave", "first")
    found = _stitched(pieces.mapInArrow(_solve_tiles, "row long, period long, b long, e long"))
    # two runs of one document differ in start or period, so they are put in order by these
    in_order = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    runs = found.groupBy("row").agg(F.transform(in_order, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    rows, none = laid.filter("octave is null"), F.array().cast(_RUNS)
    names = ["id", "n_words", "runs", "collapsed_sha256"] + ["collapsed_text"] * keep_text
    out = f"id {kind}, n_words long, runs {_RUNS}, collapsed_sha256 string" + ", collapsed_text string" * keep_text
    done = (rows.filter("sha is null").select("row", "id", "n", "text").join(runs, "row", "left")
            .select("id", "n", F.coalesce("runs", none).alias("runs"), "text").mapInArrow(_collapse(names, keep_text), out))
    if not keep_text:
        done = done.unionByName(rows.filter("sha is not null").select("id", F.col("n").alias("n_words"), none.alias("runs"), F.col("sha").alias("collapsed_sha256")))
    return done.withColumnRenamed("id", id_col)


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, with the words of every tenth document (by the checksum h of its id) made
    periodic: from word a = g % n on, g = floor(h / 10), word i becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)).  A null id counts as empty text."""
    h = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.expr("h div 10"), F.size("w").cast("long")
    p = F.expr("1 + (n - a) div (3 + g % 8)")
    tenth = renamed_input(docs, id=id_col, text=text_col).withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    tenth = tenth.withColumn("n", n).withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", p)
    made: Column = F.array_join(F.transform("w", lambda _, i: F.col("w")[F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")]), " ")
    return tenth.select(F.col("id").alias(id_col), F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias(text_col))
