"""Runs of words as sorted sets of 64-bit hashes, computed for whole Arrow batches with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"\w+")
#: Words kept with their hash by one Python worker before the store is emptied.
STORE = 500_000
_PAD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to 64-bit hash, computed on first sight."""

    def __missing__(self, word: str) -> int:
        if len(self) >= STORE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list, store: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` one after the other, and the number of words of each text."""
    found = [WORD.findall(t.lower()) if t else () for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    get = store.__getitem__
    return np.fromiter((get(w) for ws in found for w in ws), np.uint64, int(counts.sum())), counts


def runs(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, and the text it is of; a shorter text has one run, all its words."""
    own = np.repeat(np.arange(len(counts)), counts)
    padded = np.where(counts > 0, np.maximum(counts, width), 0)
    starts = np.concatenate([[0], np.cumsum(padded)])
    flat = np.full(int(starts[-1]), _PAD, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    flat[starts[own] + np.arange(len(words)) - first[own]] = words
    number = np.where(counts > 0, padded - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    before = np.concatenate([[0], np.cumsum(number)])[:-1]
    at = starts[text] + np.arange(len(text)) - before[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(3) + flat[at + k], k + 1)
    return h, text


def sets(h: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and where each text's begin (one more at the end)."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=texts))]).astype(np.int64)


def set_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, the same for equal sets; 0 for an empty set."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        at = offsets[:-1][full]
        out[full] = mix(np.add.reduceat(mix(h, 11), at) ^ mix(np.bitwise_xor.reduceat(mix(h, 23), at), 5), 7) | np.uint64(1)
    return out


def shared(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> np.ndarray:
    """How many values the k-th set of ``a`` and the k-th set of ``b`` have in common."""
    n = len(a_offsets) - 1
    pair = np.concatenate([np.repeat(np.arange(n), np.diff(a_offsets)), np.repeat(np.arange(n), np.diff(b_offsets))])
    h = np.concatenate([a, b])
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][same], minlength=n)


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as unsigned numbers and offsets of an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint64), offsets - offsets[0]


def likeness_terms(threshold: float) -> tuple[int, int]:
    """``threshold`` as an exact fraction (numerator, denominator)."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def set_table(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to batches of (id, set_key, n, runs); texts without words are left out."""
    store = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            words, counts = word_hashes(part.column(1).to_pylist(), store)
            h, offsets = sets(*runs(words, counts, width), part.num_rows)
            keep = np.flatnonzero(counts)
            keys, n = set_keys(h, offsets)[keep], np.diff(offsets)[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(keep)),
                    pa.array(keys.view(np.int64)),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64))),
                ],
                ["id", "set_key", "n", "runs"],
            )
