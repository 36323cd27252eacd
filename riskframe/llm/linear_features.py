"""Hashed word features of whole texts, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

from .order_minhash import word_hashes
from .suffix import _mix, _tables, _text_blocks

#: Bytes of texts whose features are held at once; a longer text is taken alone, in parts of words.
BLOCK = 1 << 20


def _kinds() -> np.ndarray:
    """Bit set of a byte: letter or beyond ASCII 1, digit 2, sentence mark 4, other symbol 8."""
    kind = np.full(256, 8, np.uint8)
    kind[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = 1
    kind[48:58] = 2
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return kind


def word_shapes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which kinds of bytes a word has, and its length class."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = _kinds()[data]
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, stops
    kinds = np.bitwise_or.reduceat(np.concatenate([kind, np.zeros(1, np.uint8)]), cuts)[0::2]
    return kinds.astype(np.uint64) * np.uint64(8) + np.minimum(np.log2(stops - starts + 0.5).astype(np.uint64), np.uint64(7))


def terms(words: np.ndarray, shapes: np.ndarray, owner: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash indices of the word 1- to n-grams, of the n-grams of word shapes, and of words that
    repeat the one before, with the text each is of."""
    mask = np.uint64((1 << bits) - 1)
    out, who = [], []
    with np.errstate(over="ignore"):
        for salt, base in ((1, words), (2, _mix(shapes + np.uint64(77)))):
            gram = base
            for j in range(n if salt == 1 else n + 1):
                if j:
                    gram = _mix(gram[:-1] * np.uint64(31) + base[j:])
                same = owner[: len(owner) - j] == owner[j:] if j else np.ones(len(owner), bool)
                out.append((_mix(gram + np.uint64(salt * 10 + j)) & mask)[same])
                who.append(owner[: len(owner) - j][same])
        twice = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
        out.append(np.full(len(twice), np.uint64(1)))
        who.append(owner[twice])
    return np.concatenate(out).astype(np.int64), np.concatenate(who)


def text_terms(col, bits: int, n: int):
    """Yields (first text, number of texts, term indices, text of each term) over a column."""
    tables = _tables(BLOCK)
    for i, j, data, off in _text_blocks(col, BLOCK):
        hashes, owner, starts, stops = word_hashes(data, off[1:], tables, places=True)
        index, who = terms(hashes, word_shapes(data, starts, stops), owner, bits, n)
        yield i, j - i, index, who

