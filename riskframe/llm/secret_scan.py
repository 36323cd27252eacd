"""Secret scans: fixed patterns, and windows of high Shannon entropy per character class.

A candidate is a maximal stretch of one class's characters.  A window slides over it; the sum of
c * log2(c) over the window's character counts c changes in two terms per step, so the entropy
costs the same for any window length.  Windows at the class's threshold or above are joined to
spans.  A span is suppressed by the allow-list: numbers, identifiers (uuid), digests that say so,
parts of addresses and paths, placeholders, alphabets in order, and stretches of plain words.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_view, renamed_input


class CharClass(NamedTuple):
    """Characters of a class, the window's length, the least entropy in bits a character."""
    kind: str
    chars: str
    window: int
    bits: float


#: From the narrowest alphabet to the widest.
#: A window of w characters drawn evenly from an alphabet has about log2(w) bits less what repeats
#: cost; prose in the same window stays some 0.4 bits or more below these thresholds.
CLASSES = (
    CharClass("entropy_hex", "0-9a-f", 24, 3.05),
    CharClass("entropy_hex_upper", "0-9A-F", 24, 3.05),
    CharClass("entropy_base32", "A-Z0-9", 20, 3.45),
    CharClass("entropy_base36", "a-z0-9", 20, 3.45),
    CharClass("entropy_base64", "A-Za-z0-9+/_-", 24, 4.0),
)
#: Fixed patterns of the base: kind, pattern, least length of the judged group.
BASE = (
    ("assign", rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
)
KINDS = tuple(b[0] for b in BASE) + tuple(c.kind for c in CLASSES)
#: Names that stand before a public digest, and words that mark a stand-in.
DIGEST_NAMES = (b"md5", b"sha1", b"sha224", b"sha256", b"sha384", b"sha512", b"commit", b"checksum", b"digest", b"integrity", b"etag", b"fingerprint")
STAND_INS = (b"example", b"placeholder", b"changeme", b"dummy", b"sample", b"your_", b"your-", b"xxxx", b"redacted")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def windows(data: bytes, width: int, bits: float) -> list[tuple[int, int]]:
    """Spans covered by the windows of ``width`` bytes of at least ``bits`` bits of entropy."""
    if len(data) < width:
        return []
    log = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts = [0] * 256
    total = 0.0
    limit = (math.log2(width) - bits) * width + 1e-9  # entropy = log2(width) - total / width
    out: list[list[int]] = []
    for i, new in enumerate(data):
        if i >= width:
            old = data[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += log[c - 1] - log[c]
        c = counts[new]
        counts[new] = c + 1
        total += log[c + 1] - log[c]
        if i >= width - 1 and total <= limit:
            b = i - width + 1
            if out and b <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([b, i + 1])
    return [(b, e) for b, e in out]


def allowed(raw: bytes, b: int, e: int, begin: int) -> bool:
    """True if the span b..e of the candidate from ``begin`` on is on the allow-list."""
    span = raw[b:e]
    kinds = sum(any(p(x) for x in span) for p in (_digit, _upper, _small))
    if kinds < 2 or not any(_digit(x) for x in span):
        return True  # a number, or letters only: prose, names in camel case, alphabets
    if any(w in raw[max(begin, b - 16): e].lower() for w in STAND_INS):
        return True
    steps = sum(y - x in (0, 1, -1) for x, y in zip(span, span[1:]))
    if 2 * steps > len(span):
        return True  # an alphabet or digits in order
    near = raw[max(0, begin - 40): begin]
    if any(m.start() < e and m.end() > b for m in _UUID.finditer(raw, max(0, b - 36), min(len(raw), e + 36))):
        return True
    named = near.rstrip(b" \t:=-\"'").lower()
    if any(named.endswith(w) for w in DIGEST_NAMES) or named.endswith(b";base64,"):
        return True  # a digest, or data within a page
    token = re.split(rb"[\s\"'<>()]", near)[-1]
    if b"://" in token and b"=" not in token and b"@" not in token:
        return True  # within an address, but not the value of a query or a login
    parts = [p for p in re.split(rb"[/_+-]|(?<=[a-z])(?=[A-Z])", span) if p]
    wordy = sum(len(p) for p in parts if p.isalpha() and (p.islower() or p[1:].islower()) and len(p) >= 3)
    return 2 * wordy > len(span)  # a path or a name made of words


def _digit(x: int) -> bool:
    return 48 <= x <= 57


def _upper(x: int) -> bool:
    return 65 <= x <= 90


def _small(x: int) -> bool:
    return 97 <= x <= 122


def _finders():
    """Patterns, compiled once a task: the base ones and, per class, its candidates."""
    base = [(kind, re.compile(p), group, least) for kind, p, group, least in BASE]
    shortest = min(c.window for c in CLASSES)
    return base, re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % shortest), [(c, re.compile(b"[%s]{%d,}" % (c.chars.encode(), c.window))) for c in CLASSES]


def spans_of(raw: bytes, finders) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in bytes, in order."""
    base, wide, classes = finders
    found = []
    lower = raw.lower()
    for k, (kind, pattern, group, least) in enumerate(base):
        if kind == "assign" and not any(w in lower for w in (b"passw", b"secret", b"token", b"api")):
            continue
        if kind == "access" and b"AKIA" not in raw:
            continue
        if kind == "hex":
            # shorter stretches can't pass; those of 32 and more are maximal either way
            pattern = re.compile(rb"(?<![0-9a-f])[0-9a-f]{%d,}" % least)
        for m in pattern.finditer(raw):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    held = _Cover((s, e) for s, _, e in found)
    for stretch in wide.finditer(raw):
        by_class = []
        for c, pattern in classes:
            here = [(b + m.start(), e + m.start()) for m in pattern.finditer(raw, stretch.start(), stretch.end()) for b, e in windows(raw[m.start(): m.end()], c.window, c.bits)]
            by_class.append([(b, e) for b, e in here if not held.holds(b, e) and not allowed(raw, b, e, stretch.start())])
        covers = [_Cover(x) for x in by_class]
        for i, spans in enumerate(by_class):
            for b, e in spans:
                # the longer span is told; of equal ones that of the narrower alphabet
                if not any(x.holds(b, e) for x in covers[:i]) and not any(x.holds(b, e) and (b, e) not in x.spans for x in covers[i + 1:]):
                    found.append((b, len(base) + i, e))
    return sorted(found)


class _Cover:
    """Spans, to be asked whether one of them holds a given span."""

    def __init__(self, spans):
        self.spans = set(spans)
        spans = sorted(self.spans)
        self.begins, self.ends = [b for b, _ in spans], list(accumulate((e for _, e in spans), max))

    def holds(self, b: int, e: int) -> bool:
        at = bisect_right(self.begins, b)
        return at > 0 and self.ends[at - 1] >= e


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(names: list[str]):
    def run(batches):
        finders = _finders()
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            spans, sha = [], []
            for i in range(batch.num_rows):
                raw = data[off[i]: off[i + 1]].tobytes()
                found = spans_of(raw, finders)
                if found and not raw.isascii():  # bytes to code points
                    inner = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).tolist()
                    found = [(b - bisect_right(inner, b), k, e - bisect_right(inner, e - 1)) for b, k, e in found]
                spans.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in found])
                listed = ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in found if k < len(BASE))
                sha.append(hashlib.sha256(listed.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(_SPAN)), pa.array(sha, pa.string())], names=names)
    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, spans (array of kind, start, end in code points, end
    exclusive, by start and then kind as in ``KINDS``) and base_sha256, the digest of the base
    kinds' ``kind:start:end``, comma-joined.

    Entropy spans that lie within a base span, or within one of another class, aren't repeated.
    Defined cases: a null or empty text has no spans and the digest of no bytes; ids are passed
    through, null and repeated ones too; texts of any length are read whole, in time proportional
    to it; an empty table gives an empty result; further columns are not read.
    """
    base = renamed_input(docs, id=id_col, text=text_col)
    kind = dict(base.dtypes)["id"]
    out = base.mapInArrow(_scan(["id", "spans", "base_sha256"]), f"id {kind}, spans array<struct<kind: string, start: long, end: long>>, base_sha256 string")
    return out.withColumnRenamed("id", id_col)
