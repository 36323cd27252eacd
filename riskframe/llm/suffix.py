"""Suffix-array de-duplication: remove every byte covered by a long string that occurs again.

How the work is split so that no task needs the whole corpus:

1. **Meeting points.**  Of the k-byte strings inside a window of ``min_len`` bytes the one
   with the smallest hash (the leftmost of equals) is the window's anchor.  The choice looks at
   the window's own bytes only, so two equal windows have the same anchor string.  Consecutive
   windows with one anchor form a span; a text of n bytes has about 2n/(min_len-k+2) spans and
   each window start lies in exactly one.  Only (anchor hash, span hash, place) is shuffled.
2. **Anchors met once are dropped.**  A span whose whole content is found at two places is
   repeated as a whole; that is settled by counting.  Spans that share an anchor but differ
   go, one copy each, with their bytes to a bucket of anchors.
3. **Suffix array per bucket**, by two-stage sorting (:func:`two_stage`), then common prefixes
   of neighbours: window starts whose neighbour agrees in ``min_len`` bytes are repeated.
4. An anchor with very many different spans (a passage shorter than ``min_len`` that a third of
   all documents hold) is not sorted in one task: its windows are dealt out again by a longer
   anchor, up to the full ``min_len`` bytes, where all windows of an anchor are equal.
   Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, renamed_input, text_key, written

MIN_LEN = 400
#: Passages between documents: words, and bytes, which 50 words have unless they are 3 letters long on average.
PASSAGE_WORDS, PASSAGE_LEN = 50, 200
#: Different spans of one anchor that one task sorts at most; beyond, a longer anchor deals them out.
HOT_SPANS = 1500
#: Bytes of spans in a bucket (a suffix array) on average.
BUCKET_BYTES = 1_000_000
#: Window starts that are looked at together in a task.
_BLOCK = 1 << 20
_POS = np.uint64((1 << 24) - 1)


def anchor_lengths(min_len: int) -> list[int]:
    """Anchor lengths by level, the last one the whole window."""
    return sorted({max(1, min_len * f // 25) for f in (4, 13, 21)} | {min_len})


# --- suffix sorting ---------------------------------------------------------------------------

def rises(text: np.ndarray) -> np.ndarray:
    """True at i where the suffix at i is smaller than the one at i + 1.  The last one has no
    successor and counts as not smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Order the suffixes of ``text`` that start where ``wanted`` is true by their first
    ``depth`` bytes (at least).

    Stage one sorts directly those smaller than their successor.  Stage two scans the buckets
    of first bytes in ascending order: the suffix before a sorted one, if it is the larger of
    the two, takes the next place at the front of its own bucket.  The last wanted suffix of a
    run may need its successor for that, so each run is extended to its next rising suffix.
    Buckets are scanned as arrays: everything that a bucket gets from smaller buckets is there
    when the scan reaches it, and equal bytes in a row are followed in rounds.
    """
    text = np.concatenate([text, np.array([0, 255], np.uint8)])
    up = rises(text)
    up[-1] = False
    chosen = np.zeros(len(text), bool)
    chosen[:len(wanted)] = wanted
    ends = np.flatnonzero(chosen[:-1] & ~chosen[1:] & ~up[:-1])
    if len(ends):
        risers = np.flatnonzero(up)
        stop = risers[np.searchsorted(risers, ends)]
        for a, b in zip(ends.tolist(), stop.tolist()):
            chosen[a: b + 1] = True
    raw = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(chosen & up).tolist(), key=lambda i: raw[i:i + depth]), np.int64)
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    falls = chosen & ~up
    for c in range(256):
        got = waiting[c]
        front = np.concatenate(got) if got else np.zeros(0, np.int64)
        while len(front):  # the same byte before it: it follows in the same bucket
            front = front[front > 0] - 1
            front = front[falls[front] & (text[front] == c)]
            got.append(front)
        bucket = np.concatenate([*got, direct[cut[c]: cut[c + 1]]]) if got else direct[cut[c]: cut[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        keep = (first > c) & falls[before]
        before, first = before[keep], first[keep]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edge = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, edge):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    order = order[order < len(wanted)]
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the next one, up to ``depth``."""
    lcp = np.zeros(max(0, len(order) - 1), np.int32)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))  # the 8 bytes from each place on
    left, right, active = order[:-1], order[1:], np.arange(len(lcp))
    for off in range(0, depth, 8):
        diff = words[left + off] ^ words[right + off]
        same = diff == 0
        if not same.all():
            odd = diff[~same]
            low = (odd & (~odd + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
            lcp[active[~same]] = off + (np.log2(low).astype(np.int32) >> 3)
            left, right, active = left[same], right[same], active[same]
        if not len(active):
            break
    lcp[active] = depth
    return np.minimum(lcp, depth)


def repeated_starts(spans: list[bytes], min_len: int, owners: list[int] | None = None):
    """For each span the offsets at which a string of ``min_len`` bytes starts that starts at
    another place of these spans too.  With ``owners``, a number per span: (these, those of them
    whose string a span with a smaller owner holds too)."""
    text = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum([0] + [len(s) for s in spans])
    wanted = np.zeros(len(text), bool)
    for b, e in zip(begin[:-1], begin[1:]):
        wanted[b: max(b, e - min_len + 1)] = True
    order = two_stage(text, wanted, min_len)
    equal = common_prefixes(text, order, min_len) >= min_len

    def by_span(places: np.ndarray) -> list[np.ndarray]:
        hit = np.zeros(len(text), bool)
        hit[places] = True
        at = np.flatnonzero(hit)
        cut = np.searchsorted(at, begin)
        return [at[cut[i]: cut[i + 1]] - begin[i] for i in range(len(spans))]

    all_of_them = by_span(np.concatenate([order[:-1][equal], order[1:][equal]]))
    if owners is None:
        return all_of_them
    later = np.zeros(0, np.int64)
    if len(order):
        owner = np.array(owners, np.int64)[np.searchsorted(begin, order, "right") - 1]
        group = np.concatenate([[0], np.cumsum(~equal)])
        least = np.minimum.reduceat(owner, np.flatnonzero(np.concatenate([[True], ~equal])))
        later = order[owner > least[group]]
    return all_of_them, by_span(later)


def runs(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of consecutive numbers."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1) + 1
    firsts = at[np.concatenate([[0], edge])]
    counts = np.diff(np.concatenate([[0], edge, [len(at)]]))
    return list(zip(firsts.tolist(), counts.tolist()))


# --- anchors ----------------------------------------------------------------------------------

def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of an odd base with their inverses, modulo 2^64."""
    rng = np.random.default_rng(400)
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, base, np.uint64))
        down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
    return byte, up, down


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w neighbours."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1: w - 1 + n])


def spans_of(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, k: int, min_len: int, tables, block: int = _BLOCK):
    """Spans of all windows of ``min_len`` bytes that lie inside one text.

    data: texts one after the other; ends: end of each text; owner: index of the text by byte.
    Yields (text index, first window start in data, number of windows, anchor hash, span hash).
    """
    byte, up, down = tables
    w = min_len - k + 1
    raw = data.tobytes()
    for x in range(0, max(0, len(data) - min_len + 1), block):
        part = data[x: x + block + min_len - 1]
        n = len(part) - k + 1
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[part] * up[:len(part)])])
            h = _mix((total[k:] - total[:n]) * down[:n])
        lowest = _sliding_min((h & ~_POS) | np.arange(n, dtype=np.uint64), w)
        starts = np.arange(x, x + len(lowest))
        valid = starts + min_len <= ends[owner[x: x + len(lowest)]]
        at = (lowest & _POS).astype(np.int64)
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        firsts = np.flatnonzero(new)
        if not len(firsts):
            continue
        past = np.flatnonzero(valid & np.concatenate([~valid[1:] | new[1:], [True]])) + 1
        lo = firsts + x
        count = past - firsts
        s = [xxhash.xxh3_64_intdigest(raw[b: b + c + min_len - 1]) for b, c in zip(lo.tolist(), count.tolist())]
        yield owner[lo], lo, count, h[at[firsts]].view(np.int64), np.array(s, np.uint64).view(np.int64)


_OCC = "tid binary, seg int, a long, s long, lo int, n int"
_OCC_ARROW = pa.schema([("tid", pa.binary()), ("seg", pa.int32()), ("a", pa.int64()), ("s", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def _text_blocks(col, limit: int = 1 << 20):
    """The texts of a column in runs of up to ``limit`` bytes (a longer text alone)."""
    data, off = byte_view(col)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def _extract(k: int, min_len: int):
    """Spans of pieces of texts: columns tid, seg (the piece's place in its text), text."""
    def run(batches):
        tables = _tables(_BLOCK + min_len)
        for batch in batches:
            tid, seg = batch.column("tid"), batch.column("seg").to_numpy()
            for i, j, data, off in _text_blocks(batch.column("text")):
                owner = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(off))
                for who, lo, n, a, s in spans_of(data, off[1:], owner, k, min_len, tables):
                    begin = seg[who + i].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([tid.take(pa.array(who + i)), pa.array(begin), pa.array(a), pa.array(s), pa.array((lo - off[who] + begin).astype(np.int32)), pa.array(n.astype(np.int32))], schema=_OCC_ARROW)
    return run


def _cut(min_len: int):
    """Bytes of the listed spans: columns tid, seg, text, part (bucket, d, lo, n, multi)."""
    schema = pa.schema([("bucket", pa.int32()), ("tid", pa.binary()), ("d", pa.int64()), ("lo", pa.int32()), ("multi", pa.bool_()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            for i, tid, seg, parts in zip(range(batch.num_rows), batch.column("tid"), batch.column("seg").to_pylist(), batch.column("part").to_pylist()):
                raw = data[off[i]: off[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["bucket"] for p in parts], pa.int32()), pa.array([tid.as_py()] * len(parts), pa.binary()), pa.array([p["d"] for p in parts], pa.int64()), pa.array([p["lo"] for p in parts], pa.int32()),
                    pa.array([p["multi"] for p in parts], pa.bool_()), pa.array([raw[p["lo"] - seg: p["lo"] - seg + p["n"] + min_len - 1] for p in parts], pa.binary())], schema=schema)
    return run


def _bucket(min_len: int, across: bool):
    """Suffix array of a bucket; repeated window starts (tid, lo, n) of spans that are not known
    to repeat as a whole.  With ``across`` also those, marked gone, that an earlier text holds
    too; base is the span's start."""
    schema = pa.schema([("tid", pa.binary()), ("lo", pa.int32()), ("n", pa.int32()), ("gone", pa.bool_()), ("base", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        seen, pick = set(), []
        tids, los = table.column("tid").to_pylist(), table.column("lo").to_pylist()
        for i, key in enumerate(zip(tids, los)):  # a row may come twice when a text is listed by two equal rows
            if key not in seen:
                seen.add(key)
                pick.append(i)
        spans = table.column("bytes").to_pylist()
        multi = table.column("multi").to_pylist()
        told = lambda found, gone: [(tids[i], los[i] + f, c, gone, los[i]) for i, at in zip(pick, found) if gone or not multi[i] for f, c in runs(at)]
        mine = [spans[i] for i in pick]
        if across:
            owner = table.column("d").to_pylist()
            out = [told(x, gone) for x, gone in zip(repeated_starts(mine, min_len, [owner[i] for i in pick]), (False, True))]
        else:
            out = [told(repeated_starts(mine, min_len), False)]
        out = [r for part in out for r in part]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], schema.field(j).type) for j in range(5)], schema=schema)
    return run


def _apply(min_len: int, with_text: bool):
    """Remove the covered bytes: columns of the row, text, part (lo, n) or null, whole."""
    def run(batches):
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            marks, whole = batch.column("part").to_pylist(), batch.column("whole").to_pylist()
            n_bytes, n_removed, n_spans, sha, kept, spans = [], [], [], [], [], []
            for i, (parts, all_of_it) in enumerate(zip(marks, whole)):
                raw = data[off[i]: off[i + 1]].tobytes()
                cover: list[list[int]] = [[0, len(raw)]] if all_of_it and len(raw) >= min_len else []
                for p in [] if cover else sorted((p["lo"], p["n"]) for p in parts or ()):
                    if cover and p[0] <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], p[0] + p[1] + min_len - 1)
                    else:
                        cover.append([p[0], p[0] + p[1] + min_len - 1])
                rest, at = [], 0
                for b, e in cover:
                    rest.append(raw[at:b])
                    at = e
                left = b"".join([*rest, raw[at:]])
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                n_spans.append(len(cover))
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append([{"begin": b, "end": e} for b, e in cover])
                if with_text:
                    kept.append(left.decode("utf-8", "ignore"))
            keep = [c for c in batch.schema.names if c not in ("text", "part", "whole")]
            cols = [batch.column(c) for c in keep] + [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


# --- the operator -----------------------------------------------------------------------------

def repeats(texts: DataFrame, min_len: int = MIN_LEN, hot_spans: int = HOT_SPANS, bucket_bytes: int = BUCKET_BYTES, across: bool = False) -> DataFrame:
    """Repeated windows between different places of different texts or of one text.

    texts: tid (128-bit key of the text), text.  Rows with the same tid are one text.
    Returns tid, lo, n: at lo, lo+1, .. lo+n-1 a string of ``min_len`` bytes starts that also
    starts elsewhere.  Copies of a whole text under one tid don't count here.

    With ``across`` also gone: true for windows that an earlier text holds too (in the order of a hash of the keys).  A
    window that is listed both ways is gone; one listed as not gone only is where its string stays.
    """
    marks = None
    # pieces of texts: at first whole texts, then the spans of hot anchors, which lie in a table
    one = texts.groupBy("tid").agg(F.min("row").alias("row"))
    pieces = texts.withColumn("seg", F.lit(0))
    for level, k in enumerate(anchor_lengths(min_len)):
        occ = written(pieces.select("tid", "seg", "text").mapInArrow(_extract(k, min_len), _OCC), f"spans{level}").withColumn("place", F.xxhash64("tid", "lo"))
        occ = occ.withColumn("d", F.xxhash64("tid") if across else F.lit(0).cast("long"))  # texts in the order of a hash of their keys
        met = (occ.groupBy("a").agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("d").alias("d0"))
               .filter("p0 <> p1").select("a", (F.col("s0") == F.col("s1")).alias("alike"), "d0"))
        # written, so that the join below it deals out both sides itself and splits a hot anchor
        met = written(met, f"anchors{level}")
        again = written(occ.join(met, "a"), f"met{level}")
        # one span for all places of an anchor: all of it is repeated, no need to sort
        alike = again.filter("alike").select("tid", "lo", "n", (F.col("d") > F.col("d0")).alias("gone")).distinct()
        kinds = (again.filter("not alike").groupBy("a", "s").agg(F.min(F.struct("d", "tid", "seg", "lo", "n")).alias("rep"), F.min("place").alias("p0"), F.max("place").alias("p1"))
                 .select("a", "s", "rep.*", (F.col("p0") != F.col("p1")).alias("multi")))
        kinds = written(kinds, f"kinds{level}")
        held = again.filter("not alike").join(kinds.filter("multi").select("a", "s", F.col("d").alias("first"), F.col("lo").alias("base")), ["a", "s"])
        several = held.select("tid", "lo", "n", (F.col("d") > F.col("first")).alias("gone")).distinct()
        here = alike.unionByName(several)
        marks = here if marks is None else marks.unionByName(here)
        size = kinds.agg(F.sum(F.col("n") + (min_len - 1)).alias("b")).first()["b"] or 0
        if not size:
            break
        hot = kinds.groupBy("a").agg(F.count("*").alias("spans")).filter(F.col("spans") > hot_spans).select("a", F.lit(-1).alias("hot"))
        bucket = F.pmod(F.xxhash64("a"), F.lit(int(size // bucket_bytes) + 1)).cast("int")
        parts = kinds.join(hot, "a", "left").withColumn("bucket", F.coalesce("hot", bucket)).groupBy("tid", "seg").agg(F.collect_list(F.struct("bucket", "d", "lo", "n", "multi")).alias("part"))
        if level == 0:  # of equal rows with one text, one is read
            source = pieces.join(parts.drop("seg").join(one, "tid"), ["tid", "row"])
        else:
            source = pieces.join(parts, ["tid", "seg"])
        cut = source.select("tid", "seg", "text", "part").mapInArrow(_cut(min_len), "bucket int, tid binary, d long, lo int, multi boolean, bytes binary")
        cut = written(cut.distinct() if level else cut, f"cut{level}")
        found = cut.filter("bucket >= 0").groupBy("bucket").applyInArrow(_bucket(min_len, across), "tid binary, lo int, n int, gone boolean, base int")
        found = written(found, f"sorted{level}")
        marks = marks.unionByName(found.drop("base"))
        if across:  # what a span loses, its copies in the same text lose too
            twins = held.filter("d = first and lo <> base").select("tid", "base", F.col("lo").alias("twin")).distinct()
            marks = marks.unionByName(found.filter("gone").join(twins, ["tid", "base"]).select("tid", (F.col("lo") - F.col("base") + F.col("twin")).alias("lo"), "n", "gone"))
        pieces = cut.filter("bucket < 0").select("tid", F.col("lo").alias("seg"), F.col("bytes").alias("text"))
        if pieces.isEmpty():
            break
    return marks


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                       keep_text: bool = False, hot_spans: int = HOT_SPANS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each byte covered by a ``min_len``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; a null text is empty.  Matches never cross rows; overlapping matches
    count; strings are judged on the input.  Returns one row per input row: the id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, spans (begin, end), and with
    ``keep_text`` kept_text, the rest decoded as UTF-8 (a character cut by a span's edge is
    dropped from it; the digest is of the bytes).

    Defined cases: texts shorter than ``min_len`` are never touched; a text held by two rows (same
    id or not) and at least ``min_len`` long is removed from all of them; null ids are kept as
    they are; an empty table gives an empty result; columns besides the two named are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col)
    base = base.withColumn("tid", text_key(F.col("text"))).withColumn("row", F.xxhash64("id"))
    marks = repeats(base.filter(F.octet_length("text") >= min_len), min_len, hot_spans, bucket_bytes)
    copies = base.groupBy("tid").agg((F.count("*") > 1).alias("whole"))
    ranges = marks.select("tid", "lo", "n").distinct().groupBy("tid").agg(F.collect_list(F.struct("lo", "n")).alias("part"))
    marked = copies.join(ranges, "tid", "left").filter("whole or part is not null")
    kind = dict(base.dtypes)["id"]
    out = (base.select("id", "text", "tid").join(marked, "tid", "left").select("id", "text", "part", F.coalesce("whole", F.lit(False)).alias("whole"))
           .mapInArrow(_apply(min_len, keep_text), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>" + (", kept_text string" if keep_text else "")))
    return out.withColumnRenamed("id", id_col)


def _later_passages(min_len: int, min_words: int):
    """Cut passages that an earlier text holds: columns rest, text, part (lo, n) or null."""
    def run(batches):
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            texts, removed = [], []
            for i, parts in enumerate(batch.column("part").to_pylist()):
                raw = data[off[i]: off[i + 1]].tobytes()
                pieces, at = [], 0
                for b, e in passages(raw, parts or (), min_len, min_words):
                    pieces.append(raw[at:b])
                    at = e
                texts.append(b"".join([*pieces, raw[at:]]).decode("utf-8") if at else None)
                removed.append(at > 0)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pc.coalesce(pa.array(texts, batch.column("text").type), batch.column("text")), pa.array(removed, pa.bool_())], names=["rest", "text", "cut"])
    return run


def passages(raw: bytes, parts, min_len: int, min_words: int) -> list[tuple[int, int]]:
    """Stretches of whole words, ``min_words`` or more, that the listed windows (lo, n) cover."""
    if not parts:
        return []
    starts = np.zeros(len(raw) + 1, bool)
    for p in parts:
        starts[p["lo"]: p["lo"] + p["n"]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], _covered(starts, min_len).astype(np.int8), [0]])))
    out = []
    for b, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        e = min(e, len(raw))
        while b < e and b and not raw[b - 1: b].isspace() and not raw[b: b + 1].isspace():
            b += 1  # the rest of a word that begins before
        while e > b and e < len(raw) and not raw[e - 1: e].isspace() and not raw[e: e + 1].isspace():
            e -= 1
        if b < e < len(raw) and b and not raw[b - 1: b].isspace() and not raw[e: e + 1].isspace():
            e -= 1  # one blank stays between the words around
        if len(raw[b:e].split()) >= min_words:
            out.append((b, e))
    return out


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Places within ``width`` from a start on."""
    step = np.zeros(len(starts) + width, np.int32)
    step[:len(starts)] += starts
    step[width:] -= starts
    return np.cumsum(step)[:len(starts)] > 0


def without_later_passages(docs: DataFrame, text_col: str = "text", min_len: int = PASSAGE_LEN, min_words: int = PASSAGE_WORDS,
                           hot_spans: int = HOT_SPANS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Passages that several texts hold stay in one of them, the first by a hash of its text key.

    A byte goes if a string of ``min_len`` bytes covers it that an earlier text holds too, so it
    stands, in the same surroundings, in an earlier text that keeps it; only whole words go, and
    only stretches of ``min_words`` of them or more.  What a text repeats by itself stays.
    Returns rest (struct of the caller's other columns), text, cut (whether anything went).

    Defined cases: null, empty and short texts stay as they are; rows with one text are one text
    and are cut alike; an empty table gives an empty result; columns may have any name.
    """
    others = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    base = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("rest"), docs[f"`{text_col}`"].alias("text"))
    base = base.withColumn("tid", text_key(F.col("text"))).withColumn("row", F.xxhash64("rest"))
    marks = repeats(base.filter(F.octet_length("text") >= min_len).select("tid", "row", "text"), min_len, hot_spans, bucket_bytes, across=True)
    touched = marks.filter("gone").groupBy("tid").agg(F.collect_set(F.struct("lo", "n")).alias("part"))
    kind = base.schema["rest"].dataType.simpleString()
    return base.join(touched, "tid", "left").select("rest", "text", "part").mapInArrow(_later_passages(min_len, min_words), f"rest {kind}, text string, cut boolean")
