"""Near-duplicates by Order MinHash: sketches sensitive to edit similarity, candidates verified
by banded alignment, classes as connected components.

A text is a sequence of words (runs of bytes that are not ASCII white space, A-Z as a-z).  Its
k-mers are five words in a row, each labelled with its occurrence number in the text.  One sketch
value takes the ``width`` labelled k-mers with the smallest hashes and keeps them in text order,
so texts agree in it only if they share these k-mers in the same order.  Equal texts are one
text from the start.

Candidates: each text is compared with the smallest text of each of its sketch values (a star,
never all pairs of a group), first with the one that it shares most values with, then with those
that are not in its class by then.  Buckets that then still hold more than one class are opened
further: in small ones all texts of different classes are compared; in larger ones each text is
first compared with one text, the same in buckets alike, and then with every text of another class
that shares one of its rarest words, counted with their occurrence numbers, as every pair that
passes must.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, renamed_input, text_key, written
from .components import connected_components
from .suffix import _mix, _tables, _text_blocks

K_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 128
WIDTH = 2
#: Texts of a bucket that are compared across classes at once (at most SMALL^2/2 pairs a bucket).
SMALL = 12
#: Rounds in which the texts of a larger bucket meet a leader, before its remaining classes are compared in full.
ROUNDS = 1
#: Rare words before a shared one that are looked at for an earlier shared one.
BEFORE = 8
#: Words of texts, at most, whose columns are held as bits (a number of that many bits for each different word).
BITS = 1 << 14

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, ends: np.ndarray, tables, limit: int = 1 << 20, places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of texts that lie one after the other, and each word's text.
    Words end at white space and at the ends of texts.  places: also each word's begin and end."""
    byte, up, down = tables
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends[ends < n]] = True
    edge[0] = True
    starts = np.flatnonzero(word & (edge[:n] | np.concatenate([[True], ~word[:-1]])))
    stops = np.flatnonzero(word & np.concatenate([~word[1:] | edge[1:n], [True]])) + 1 if n else starts
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + limit, "right")))
        lo, hi = starts[i], stops[j - 1]
        with np.errstate(over="ignore"):
            if hi - lo > len(up):  # one word longer than the tables
                acc, inverse = np.uint64(0), pow(0x9E3779B97F4A7C15, -1, 1 << 64)
                for x in range(int(lo), int(hi), len(up)):
                    part = byte[_LOWER[data[x: min(hi, x + len(up))]]] * up[: min(hi, x + len(up)) - x]
                    acc = acc * np.uint64(inverse) + part.sum(dtype=np.uint64)
                out[i] = acc
            else:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[_LOWER[data[lo:hi]]] * up[: hi - lo])])
                out[i:j] = (total[stops[i:j] - lo] - total[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    found = _mix(out + (stops - starts).astype(np.uint64)), np.searchsorted(ends, starts, "right")
    return (*found, starts, stops) if places else found


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of one text with their occurrence numbers; a shorter text with words
    has one k-mer, all of it."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = _mix(h + words[j: j + n] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
        order = np.argsort(h, kind="stable")
        first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        at = np.arange(n)
        times = np.empty(n, np.uint64)
        times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        return _mix(h + times * np.uint64(0xD6E8FEB86659FD93))


def sketch(kmers: np.ndarray, seeds: np.ndarray, width: int, block: int = 1 << 15) -> np.ndarray:
    """One value per seed: hash of the ``width`` k-mers with the smallest hashes in text order."""
    m = len(seeds)
    best_v = np.zeros((m, 0), np.uint64)
    best_at = np.zeros((m, 0), np.int64)
    rows, factors = np.arange(m), seeds | np.uint64(1)
    for x in range(0, len(kmers), block):
        with np.errstate(over="ignore"):
            v = (kmers[None, x: x + block] ^ seeds[:, None]) * factors[:, None]  # the k-mers are mixed already
        at = np.broadcast_to(np.arange(x, x + v.shape[1]), v.shape)
        if best_v.shape[1]:
            v, at = np.concatenate([best_v, v], 1), np.concatenate([best_at, at], 1)
        if v.shape[1] > width:
            low = np.empty((m, width), np.int64)
            low_v = np.empty((m, width), np.uint64)
            for j in range(width):  # the smallest, one after the other
                low[:, j] = v.argmin(axis=1)
                low_v[:, j] = v[rows, low[:, j]]
                v[rows, low[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            v, at = low_v, np.take_along_axis(at, low, 1)
        best_v, best_at = v, at
    best_at = np.sort(best_at, axis=1)
    key = seeds.copy()
    with np.errstate(over="ignore"):
        for j in range(best_at.shape[1]):
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + kmers[best_at[:, j]])
    return key


def seeds(m: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, m, dtype=np.uint64)


def _sketches(k: int, m: int, width: int):
    schema = pa.schema([("tid", pa.binary()), ("row", pa.int64()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        tables, seed = _tables(1 << 20), seeds(m)
        for batch in batches:
            tid, row = batch.column("tid"), batch.column("row")
            for i, j, data, off in _text_blocks(batch.column("text"), 1 << 20):
                hashes, owner = word_hashes(data, off[1:], tables)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                keys, length = [], []
                for t in range(j - i):
                    words = hashes[cut[t]: cut[t + 1]]
                    length.append(len(words))
                    keys.append(sketch(labelled_kmers(words, k), seed, width).view(np.int64) if len(words) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([tid.slice(i, j - i), row.slice(i, j - i), pa.array(length, pa.int64()), lists], schema=schema)
    return run


# --- alignment --------------------------------------------------------------------------------

def _bit_distance(a: list, b: list, most: int) -> int:
    """Edit distance if it is at most ``most``, else most + 1: a word of ``b`` after the other, a column
    of differences (one up, one down) held as the bits of two whole numbers."""
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score, left = full, 0, len(a), len(b)
    for w in b:
        left -= 1
        same = at.get(w, 0) | down
        same |= ((same & up) + up) ^ up
        right = down | (full & ~(same | up))
        back = up & same
        if right & top:
            score += 1
        elif back & top:
            score -= 1
        if score - left > most:  # each word left takes back one at most
            return most + 1
        right = right << 1 | 1
        up = full & (back << 1 | ~(same | right))
        down = full & right & same
    return score


def word_distance(a: list, b: list, most: int) -> int:
    """Edit distance (insert, delete, replace a word) if it is at most ``most``, else most + 1.

    Alignment in a band of diagonals: for e = 0, 1, .. edits the furthest place that each
    diagonal of the band reaches, at most 2e + 1 of them.  Where these steps grow to more than one a
    word, the columns are gone through instead."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    short = min(len(a), len(b))
    while lo < short and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < short - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo: len(a) - hi], b[lo: len(b) - hi]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    if n == m == 1:
        return 1
    # as many words as the other text has not must be edited in any alignment
    count: dict = {}
    for w in a:
        count[w] = count.get(w, 0) + 1
    shared = 0
    for w in b:
        if count.get(w, 0):
            count[w] -= 1
            shared += 1
    if max(n, m) - shared > most:
        return most + 1
    # an edit undoes two pairs of neighbours at most
    missing = len(b) - 1
    pairs: dict = {}
    for p in zip(a, a[1:]):
        pairs[p] = pairs.get(p, 0) + 1
    for p in zip(b, b[1:]):
        if pairs.get(p, 0):
            pairs[p] -= 1
            missing -= 1
    if missing > 2 * most or missing + n - m > 2 * most:
        return most + 1
    goal, reach = n - m, {0: 0}
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    reach[0] = i
    # so many edits at least, and so many for which the diagonals take fewer steps than the columns
    least, few = max(max(n, m) - shared, (missing + max(0, n - m) + 1) // 2), int(min(n, m) ** 0.5) if max(n, m) <= BITS else most
    if least > few:
        return _bit_distance(a, b, most) if n > m else _bit_distance(b, a, most)
    for e in range(1, most + 1):
        if e > few:
            return _bit_distance(a, b, most) if n > m else _bit_distance(b, a, most)
        now = {}
        # what is further off the last diagonal than edits are left can't come back
        for d in range(max(-e, -m, goal - (most - e)), min(e, n, goal + most - e) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
            if i < 0:
                continue
            i = min(i, n, m + d)
            j = i - d
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            now[d] = i
        if now.get(goal, -1) >= n:
            return e
        reach = now
    return most + 1


def _align(similarity: float):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def words(raw: bytes) -> list[bytes]:
        return raw.lower().split()

    def run(batches):
        last_y, last = None, []
        for batch in batches:
            xs, ys = [], []
            bytes_x, bytes_y = batch.column("text_x").cast(pa.binary()), batch.column("text_y").cast(pa.binary())
            for x, y, tx, ty in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), bytes_x, bytes_y):
                if y != last_y:
                    last_y, last = y, words(ty.as_py())
                w = words(tx.as_py())
                longest = max(len(w), len(last))
                most = int(longest * (1 - similarity) + 1e-9)
                if word_distance(w, last, most) <= most:
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], schema=schema)
    return run


# --- the operator -----------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS, similarity: float = SIMILARITY,
                    sketches: int = SKETCHES, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """One row per input row: the id, tid (128-bit key of the text), class_id (smallest id of its
    class), n_words, class_tid (smallest tid of its class, which tells classes apart whatever the ids are).

    Two texts are linked if they are equal, or share a sketch value and the edit distance of
    their word sequences is at most (1 - similarity) of the longer one; a class is a connected
    component of the links.  Sketching is probabilistic: with 128 values of width 2, texts that
    share 60 % or 40 % of their k-mers meet with a probability above 0.9999; with a fifth of the words
    changed at random places (edit similarity 0.8) 0.985 of 300-word texts met; none would if each fifth is.

    Defined cases: a null text is empty; texts without words are linked if equal only; texts
    with fewer than ``k`` words have one k-mer; rows with a null id take part (class_id is null
    only if all ids of the class are); an empty table gives an empty result; further columns
    are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col).withColumn("tid", text_key(F.col("text"))).withColumn("row", F.xxhash64("id"))
    each = base.select("tid", "row", "text").mapInArrow(_sketches(k, sketches, width), "tid binary, row long, n_words long, keys array<long>")
    texts = each.groupBy("tid").agg(F.min(F.struct("row", "n_words", "keys")).alias("t")).select("tid", "t.*")
    texts = written(texts.withColumn("rid", F.monotonically_increasing_id()), "sketches")
    roots = _classes(base, texts, similarity, sketches, small)
    named = texts.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("tid", "n_words", F.coalesce("root", "rid").alias("root"))
    ids = base.groupBy("tid").agg(F.min("id").alias("id"))
    best = named.join(ids, "tid").groupBy("root").agg(F.min("id").alias("class_id"), F.min("tid").alias("class_tid"))
    classes = named.join(best, "root").select("tid", "n_words", "class_id", "class_tid")
    return base.select("id", "tid").join(classes, "tid").select(F.col("id").alias(id_col), "tid", "class_id", "n_words", "class_tid")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (x, y): only the roots that these join are relabelled.
    A root is the smallest node of its class and is listed itself; texts without a link are not."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    ends = links.join(at("x"), "x", "left").join(at("y"), "y", "left").select(F.coalesce("rx", "x").alias("u"), F.coalesce("ry", "y").alias("v"))
    joined = connected_components(ends)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(joined.join(roots, "node", "left_anti")), "classes")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (x, y) whose ends are not in one class yet; the others would link nothing."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    both = pairs.join(at("x"), "x", "left").join(at("y"), "y", "left")
    return both.filter(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y")


def _verified(held: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of text numbers that pass the alignment; each y's pairs lie together."""
    first = held.select(F.col("rid").alias("x"), F.col("text").alias("text_x"))
    second = held.select(F.col("rid").alias("y"), F.col("text").alias("text_y"))
    both = pairs.join(first, "x").join(second, "y").select("x", "y", "text_x", "text_y")
    return written(both.mapInArrow(_align(similarity), "x long, y long"), "links")


def _classes(base: DataFrame, texts: DataFrame, similarity: float, sketches: int, small: int) -> DataFrame:
    """(node, root) of the texts that have a link."""
    # every text with its sketch values that another text has too
    rows = texts.select("rid", F.explode("keys").alias("key"))
    lead = rows.groupBy("key").agg(F.min("rid").alias("y"), F.max("rid").alias("last")).filter("y <> last").select("key", "y")
    rows = written(rows.join(lead, "key"), "met")
    needed = texts.join(rows.select("rid").distinct(), "rid").select("rid", "tid", "row")
    held = written(base.join(needed, ["tid", "row"]).select("rid", "text").dropDuplicates(["rid"]), "texts")
    # each text against the smallest of its bucket: first the one that it meets in most buckets, then the others of another class
    pairs = written(rows.filter("rid <> y").groupBy(F.col("rid").alias("x"), "y").agg(F.count("*").alias("times")), "pairs")
    close = pairs.groupBy("x").agg(F.max_by("y", F.struct("times", -F.col("y"))).alias("y"))
    links = _verified(held, close, similarity)
    rows, pairs = rows.select("key", "rid"), pairs.select("x", "y")
    roots = connected_components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    apart = written(_apart(pairs, roots).join(close, ["x", "y"], "left_anti"), "pairs")
    if not apart.isEmpty():
        links = _verified(held, apart, similarity)
        if not links.isEmpty():
            roots = _merged(roots, links)
    for turn in range(ROUNDS + 1):
        # buckets that still hold more than one class, each with a leader: the text that a hash of this turn puts first
        seen = rows.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("root"))
        order = F.xxhash64("rid", F.lit(turn))
        mixed = seen.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("rid", order).alias("y"), F.min_by("root", order).alias("ry"))
        rows = written(seen.join(mixed.filter("r0 <> r1").select("key", "n", "y", "ry"), "key"), "open")
        if rows.isEmpty():
            return roots
        large = rows.filter(F.col("n") > small)
        if turn < ROUNDS:
            # large buckets: against the leader, mostly of a large family; buckets with the same texts have the same one
            found = large.filter("root <> ry").select(F.col("rid").alias("x"), "y")
        else:
            # then every pair of different classes that can pass
            found = _possible(held, texts, large.select("rid", "root").distinct(), similarity)
        if not turn:
            # small buckets: all pairs across classes
            few = rows.filter(F.col("n") <= small).select("key", "rid", "root")
            other = few.select("key", F.col("rid").alias("y"), F.col("root").alias("ry"))
            found = found.unionByName(few.join(other, "key").filter("rid > y and root <> ry").select(F.col("rid").alias("x"), "y"))
        rows = written(large.select("key", "rid"), "large")
        found = found.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        found = written(found.join(pairs, ["x", "y"], "left_anti"), "pairs")
        if not found.isEmpty():
            pairs = pairs.unionByName(found)
            new = _verified(held, found, similarity)
            if not new.isEmpty():
                roots = _merged(roots, new)
    return roots


def _numbered_words(batches):
    """All words of each text, each with its occurrence number in the text."""
    schema = pa.schema([(name, pa.int64()) for name in ("rid", "root", "n", "word")])
    tables = _tables(1 << 20)
    for batch in batches:
        rid, root = (batch.column(name).to_numpy() for name in ("rid", "root"))
        for i, j, data, off in _text_blocks(batch.column("text"), 1 << 20):
            hashes, owner = word_hashes(data, off[1:], tables)
            cut = np.searchsorted(owner, np.arange(j - i + 1))
            numbered = [labelled_kmers(hashes[cut[t]: cut[t + 1]], 1) for t in range(j - i)]
            size = np.diff(cut)
            columns = np.repeat(rid[i:j], size), np.repeat(root[i:j], size), np.repeat(size, size), np.concatenate([np.zeros(0, np.uint64), *numbered]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def _possible(held: DataFrame, texts: DataFrame, some: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) of different classes of ``some`` (rid, root) that share a sketch value and may
    pass the alignment; none that passes is left out.

    Words count with their occurrence numbers, so a text of n words is a set of n, and each edit
    takes one of them at most.  If x, of n words, and y, of m <= n, are e edits apart at most, they
    share n - e or more.  In one order of all words, the rarest first, the first that they share
    is therefore among the first e + 1 of x and the first m - n + e + 1 of y.  Words of one class only
    come first in that order and meet nothing.  A pair that shares several rare words is taken at the
    first: where one of the ``BEFORE`` rare words before is shared too, it was taken there or earlier."""
    words = held.join(some, "rid").select("rid", "root", "text").mapInArrow(_numbered_words, "rid long, root long, n long, word long")
    words = written(words, "words")
    times = words.groupBy("word").agg(F.count("*").alias("times"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    shared = words.join(times.filter("r0 <> r1").select("word", "times"), "word")
    each = Window.partitionBy("rid")
    order = each.orderBy("times", "word")
    most = F.floor(F.col("n") * (1 - similarity) + 1e-9)
    rare = shared.withColumn("most", most).withColumn("k", F.row_number().over(order) + F.col("n") - F.count("*").over(each)).filter("k <= most + 1")
    rare = written(rare.withColumn("before", F.collect_list("word").over(order.rowsBetween(-BEFORE, -1))).select("rid", "root", "n", "most", "word", "k", "before"), "rare")
    first = rare.select("word", F.col("rid").alias("x"), F.col("root").alias("rx"), "n", "most", F.col("before").alias("bx"))
    second = rare.select("word", F.col("rid").alias("y"), F.col("root").alias("ry"), F.col("n").alias("m"), "k", F.col("before").alias("by"))
    near = (F.col("rx") != F.col("ry")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("y") < F.col("x"))))
    near = near & (F.col("k") <= F.col("m") - F.col("n") + F.col("most") + 1) & ~F.arrays_overlap("bx", "by")
    pairs = first.join(second, (first["word"] == second["word"]) & near).select("x", "y").distinct()
    keys = lambda end: texts.select(F.col("rid").alias(end), F.col("keys").alias(f"k{end}"))
    return pairs.join(keys("x"), "x").join(keys("y"), "y").filter(F.arrays_overlap("kx", "ky")).select("x", "y")
