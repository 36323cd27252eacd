"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a model file (a parameter); nothing is trained.  A text's white space
is marked by U+2581, one mark is put in front, and the marked text is cut into the pieces with
the largest sum of scores.  Characters of no piece are encoded as their UTF-8 bytes.  Pieces hold
the mark only at their front, so the best cut of a text is that of its words one after the other;
each task keeps the cuts of words it has seen, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import renamed_input

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of late whose cut a task remembers, and as many of those before them.
MEMORY = 150_000
#: Taken from the smallest score for a character of no piece.
UNKNOWN_PENALTY = 10.0


# --- model file -------------------------------------------------------------------------------

def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    def varint(i):
        out = shift = 0
        while True:
            b = raw[i]
            out |= (b & 127) << shift
            shift, i = shift + 7, i + 1
            if b < 128:
                return out, i
    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i: i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i: i + n], i + n
        yield key >> 3, value


@dataclass(frozen=True)
class Pieces:
    text: list[str]
    score: list[float]
    kind: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte


def read_model(raw: bytes) -> Pieces:
    text, score, kind = [], [], []
    for number, value in _fields(raw):
        if number == 1:
            one = dict(_fields(value))
            text.append(one.get(1, b"").decode("utf-8"))
            score.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            kind.append(one.get(3, 1))
    return Pieces(text, score, kind)


# --- double-array trie ------------------------------------------------------------------------

def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: from state s byte c leads to t = base[s] + c if
    check[t] = s; value[t] is the key's number or -1."""
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    keys = sorted(keys)
    free = 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        groups, i = [], lo
        while i < hi:
            c, j = keys[i][0][depth], i
            while j < hi and keys[j][0][depth] == c:
                j += 1
            groups.append((c, i, j))
            i = j
        if not groups:
            continue
        while check[free] != -1:
            free += 1
        b = max(1, free - groups[0][0])
        for tries in itertools.count():
            if b + 256 >= len(base):
                for a, x in ((base, 0), (check, -1), (value, -1)):
                    a.extend([x] * size)
            if all(check[b + c] == -1 for c, _, _ in groups):
                break
            b += 1
        if tries > 30:  # few gaps here: leave them
            free = max(free, b)
        base[state] = b
        for c, i, j in groups:
            check[b + c] = state
            todo.append((b + c, i, j, depth + 1))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Codec:
    """Encoder and decoder over a double-array trie; lives in a task."""

    def __init__(self, pieces: Pieces, trie: tuple[np.ndarray, np.ndarray, np.ndarray], memory: int = MEMORY):
        self.base, self.check, self.value = (a.tolist() for a in trie)
        self.score, self.memory = pieces.score, memory
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)) if k == 6}
        self.unk = pieces.kind.index(2) if 2 in pieces.kind else 0
        self.penalty = min((s for s, k in zip(pieces.score, pieces.kind) if k == 1), default=0.0) - UNKNOWN_PENALTY
        self.out = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else t.replace(MARK, " ").encode() for t, k in zip(pieces.text, pieces.kind)]
        self.whole = all(MARK not in t.lstrip(MARK) for t, k in zip(pieces.text, pieces.kind) if k in (1, 4, 5))
        self.low = set(self.byte_id.values())
        # words met of late, and those before them: what is met again comes over when the first are full
        self.seen: dict[str, tuple[bytes, bytes, int]] = {}
        self.before: dict[str, tuple[bytes, bytes, int]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the cut with the largest sum of scores; of equal sums the first found wins."""
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        best, came, how = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.base, self.check, self.value, self.score
        i = 0
        while i < n:
            lead = raw[i]
            width = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            here, s, single = best[i], 0, False
            # a state without children has base 0 and is nobody's check; the arrays go 256 beyond each base
            for end, byte in enumerate(raw[i:], i + 1):
                t = base[s] + byte
                if check[t] != s:
                    break
                s = t
                piece = value[s]
                if piece >= 0:
                    if end == i + width:
                        single = True
                    total = here + score[piece]
                    if total > best[end]:
                        best[end], came[end], how[end] = total, i, piece
            if not single and here + self.penalty > best[i + width]:
                best[i + width], came[i + width], how[i + width] = here + self.penalty, i, -1
            i += width
        ids: list[int] = []
        while n:
            part = came[n]
            ids.extend([how[n]] if how[n] >= 0 else reversed([self.byte_id.get(b, self.unk) for b in raw[part:n]]) if self.byte_id else [self.unk])
            n = part
        return tuple(reversed(ids))

    def _part(self, key: str) -> tuple[bytes, bytes, int]:
        """Ids (as int32), decoded bytes and number of byte pieces of the cut of ``key``."""
        ids = self.viterbi(key)
        return np.array(ids, np.int32).tobytes(), b"".join([self.out[i] for i in ids]), sum(i in self.low for i in ids)

    def parts(self, text: str) -> list[tuple[bytes, bytes, int]]:
        """What ``_part`` gives for each word in turn; joined, that of the whole text, since no piece
        goes over the marks in front of a word."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if not self.whole:
            return [self._part(MARK + marked)]
        words = marked.split(MARK)
        if "" not in words:
            got = list(map(self.seen.get, words))
            for i, one in enumerate(got):
                if one is None:
                    got[i] = self._remembered(words[i])
            return got
        got, gap = [], ""
        for word in words:
            # marks in front of a word, beside its own, go with it
            if word:
                got.append(self._remembered(gap + word))
                gap = ""
            else:
                gap += MARK
        if gap:
            got.append(self._part(gap))
        return got

    def _remembered(self, key: str) -> tuple[bytes, bytes, int]:
        one = self.seen.get(key)
        if one is None:
            one = self.before.get(key) or self._part(MARK + key)
            if len(key) < 100:
                if len(self.seen) >= self.memory:
                    self.before, self.seen = self.seen, {}
                self.seen[key] = one
        return one

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.parts(text)]), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the pieces: bytes joined (invalid ones as U+FFFD), marks as spaces, without the one in front."""
        out = self.out
        return self.text(b"".join([out[i] for i in ids]))

    @staticmethod
    def text(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(spark: SparkSession, path: str = MODEL):
    """The model's pieces and their trie as a broadcast (its size is that of the vocabulary)."""
    local = path.removeprefix("file://")
    if "://" in local:
        raw = bytes(spark.sparkContext.binaryFiles(local).first()[1])
    else:
        with open(local, "rb") as f:
            raw = f.read()
    pieces = read_model(raw)
    trie = double_array([(t.encode(), i) for i, (t, k) in enumerate(zip(pieces.text, pieces.kind)) if k in (1, 4, 5) and t])
    return spark.sparkContext.broadcast(((pieces.text, pieces.score, pieces.kind), trie))


def _encode(model, keep: list[str]):
    def run(batches):
        codec = Codec(Pieces(*model.value[0]), model.value[1])
        for batch in batches:
            texts = batch.column("text")
            for x in range(0, batch.num_rows, 512):
                ids, n_bytes, same, sha = [], [], [], []
                for t in texts.slice(x, 512):
                    text = t.as_py() or ""
                    parts = codec.parts(text)
                    back = codec.text(b"".join([p[1] for p in parts]))
                    ids.append(np.frombuffer(b"".join([p[0] for p in parts]), np.int32))
                    n_bytes.append(sum([p[2] for p in parts]))
                    same.append(back == text)
                    sha.append(hashlib.md5(back.encode("utf-8", "replace")).hexdigest())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(x, 512) for c in keep), lists, pa.array([len(i) for i in ids], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same), pa.array(sha)],
                                                 names=[*keep, "ids", "n_tokens", "n_byte_tokens", "round_trip", "decoded_md5"])
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: the id, ids (pieces), n_tokens, n_byte_tokens (of byte fallback),
    round_trip (decoding the ids gives the text again) and decoded_md5.

    Defined cases: a null or empty text has no pieces; characters of no piece become bytes (the
    unknown piece if the model has no bytes); repeated rows stay; an empty table gives an empty
    result; further columns are not read.  A text that holds U+2581 decodes with spaces there.
    """
    base = renamed_input(docs, id=id_col, text=text_col)
    shared = load(docs.sparkSession, model)
    out = base.mapInArrow(_encode(shared, ["id"]), f"id {dict(base.dtypes)['id']}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean, decoded_md5 string")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The id and the text of each row's pieces; null ids give an empty text."""
    base = renamed_input(tokens, id=id_col, ids=ids_col)
    shared = load(tokens.sparkSession, model)

    def run(batches):
        codec = Codec(Pieces(*shared.value[0]), shared.value[1])
        for batch in batches:
            text = [codec.decode(i.as_py() or []) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], names=["id", "text"])

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, text string").withColumnRenamed("id", id_col)
