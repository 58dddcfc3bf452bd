"""A compressed full-text index over sequences of words (64-bit hashes): an FM-index on a wavelet matrix.

The texts are laid end to end, each closed by an end mark of its own. Kept are the Burrows-Wheeler transform of the full suffix
order as bit planes with rank counts (about 1.25 bits per bit of a symbol), the sorted vocabulary, every ``SAMPLE``-th entry of
the suffix array, and the row of every ``BLOCK``-th position, where extraction may start. Neither the texts nor the suffix array
are kept: texts are read back out of the transform. All functions work on whole arrays of queries.
"""

from __future__ import annotations

import io
import posixpath

import numpy as np
import pyarrow.fs as pafs

#: Text positions per suffix-array entry kept, and per row kept for extraction.
SAMPLE, BLOCK = 4, 64
_ARRAYS = ("vocabulary", "first", "start", "planes", "near", "far", "zeros", "marks", "mark_near", "mark_far", "samples", "rows", "begins", "sizes", "keys")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; the end marks in it must all differ.

    Prefix doubling, in which only suffixes that still share their rank are sorted again.
    """
    n, top = len(text), int(text.max()) + 1 if len(text) else 1
    key, width = text.astype(np.int64), 1
    while top ** (width + 1) < 1 << 62 and width < 3:
        later = np.zeros(n, np.int64)
        later[:-width] = text[width:]
        key = key * top + later
        width += 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[np.minimum(at + width, n - 1)]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def _packed(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits in 64-bit words, and the ones before each word: within and before its group of 1 024 words."""
    words = np.zeros(len(flags) // 64 + 1, np.uint64)
    packed = np.packbits(flags, bitorder="little")
    words.view(np.uint8)[: len(packed)] = packed
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])
    far = before[::1024]
    return words, (before - np.repeat(far, 1024)[: len(before)]).astype(np.uint16), far.astype(np.uint32)


def _ones(words: np.ndarray, near: np.ndarray, far: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ones stand before each position."""
    word = at >> 6
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return far[word >> 10].astype(np.int64) + near[word] + np.bitwise_count(words[word] & below)


def build(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """The index of the texts ``words[offsets[k]:offsets[k + 1]]``, with a number and a key kept for each."""
    texts = len(offsets) - 1
    counts = np.diff(offsets)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    n = int(begins[-1])
    vocabulary, symbol = np.unique(words, return_inverse=True)
    own = np.repeat(np.arange(texts), counts)
    spot = begins[own] + np.arange(len(words)) - offsets[own]
    flat = np.zeros(n, np.int64)  # 0: the end of a text
    flat[spot] = symbol + 1
    ranked = flat + texts - 1
    ranked[begins[1:] - 1] = np.arange(texts)  # end marks differ and come first, in the order of the texts
    order = suffix_order(ranked)
    del ranked, symbol, own, spot
    bwt = flat[order - 1]
    levels = max(1, int(len(vocabulary)).bit_length())
    first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(vocabulary) + 1))])
    planes, near, far, zeros = [], [], [], []
    start = np.zeros(len(vocabulary) + 1, np.int64)
    symbols = np.arange(len(vocabulary) + 1)
    for level in range(levels - 1, -1, -1):
        bit = (bwt >> level) & 1
        plane = _packed(bit.astype(np.uint8))
        for held, part in zip((planes, near, far), plane):
            held.append(part)
        zeros.append(n - int(bit.sum()))
        bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        ones = _ones(*plane, start)
        start = np.where((symbols >> level) & 1, zeros[-1] + ones, start - ones)
    marked = order % SAMPLE == 0
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    marked[row_of[begins[:-1]]] = True
    marks, mark_near, mark_far = _packed(marked.astype(np.uint8))
    return {
        "vocabulary": vocabulary, "first": first.astype(np.uint32), "start": start.astype(np.uint32), "planes": np.stack(planes), "near": np.stack(near), "far": np.stack(far),
        "zeros": np.array(zeros, np.int64), "marks": marks, "mark_near": mark_near, "mark_far": mark_far, "samples": order[marked].astype(np.uint32),
        "rows": row_of[::BLOCK].astype(np.uint32), "begins": begins, "sizes": sizes, "keys": keys,
    }


def stored_bytes(index: dict[str, np.ndarray]) -> int:
    """Bytes of all arrays of an index."""
    return sum(a.nbytes for a in index.values())


def symbols_of(index: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """The index's symbols of word hashes, 0 for words it doesn't hold."""
    vocabulary = index["vocabulary"]
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    known, inverse = np.unique(words, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, known), len(vocabulary) - 1)
    return np.where(vocabulary[at] == known, at + 1, 0)[inverse]


def _back(index: dict[str, np.ndarray], symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One backward step: the row that ``symbol`` before each row boundary leads to."""
    levels = len(index["zeros"])
    planes, near, far, zeros = index["planes"], index["near"], index["far"], index["zeros"]
    row = at
    for k in range(levels):
        ones = _ones(planes[k], near[k], far[k], row)
        row = np.where((symbol >> (levels - 1 - k)) & 1, zeros[k] + ones, row - ones)
    return index["first"][symbol].astype(np.int64) + row - index["start"][symbol]


def search(index: dict[str, np.ndarray], patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows [lo, hi) of the suffixes that begin with each of ``patterns``, arrays of equally many symbols, by backward search."""
    lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    live = np.flatnonzero((patterns > 0).all(axis=1))
    last = patterns[live, -1]
    lo[live], hi[live] = index["first"][last], index["first"][last + 1]
    for k in range(patterns.shape[1] - 2, -1, -1):
        live = live[hi[live] > lo[live]]
        both = _back(index, np.tile(patterns[live, k], 2), np.concatenate([lo[live], hi[live]]))
        lo[live], hi[live] = both[: len(live)], both[len(live) :]
    empty = hi <= lo
    lo[empty] = hi[empty] = 0
    return lo, hi


def step(index: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each row's suffix, and the row of the suffix that begins with it (of no use at the start of a text)."""
    symbol, at = np.zeros(len(rows), np.int64), rows
    for plane, near, far, zeros in zip(index["planes"], index["near"], index["far"], index["zeros"]):
        bit = ((plane[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
        ones = _ones(plane, near, far, at)
        at = np.where(bit, zeros + ones, at - ones)
        symbol = symbol * 2 + bit
    return symbol, index["first"][symbol].astype(np.int64) + at - index["start"][symbol]


def locate(index: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each row's suffix, and its place in that text."""
    at, walked = rows.astype(np.int64), np.zeros(len(rows), np.int64)
    marks, near, far = index["marks"], index["mark_near"], index["mark_far"]
    open_ = np.arange(len(rows))
    for k in range(SAMPLE):
        here = at[open_]
        known = ((marks[here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        walked[open_[known]] = k
        open_ = open_[~known]
        if not len(open_):
            break
        at[open_] = step(index, at[open_])[1]
    position = index["samples"][_ones(marks, near, far, at)].astype(np.int64) + walked
    text = np.searchsorted(index["begins"], position, side="right") - 1
    return text, position - index["begins"][text]


def extract(index: dict[str, np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of ``texts`` one after the other, and where each begins, read backwards in blocks that advance together."""
    begin, end = index["begins"][texts], index["begins"][texts + 1] - 1
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    inner = np.maximum(0, (end - 1) // BLOCK - begin // BLOCK)  # kept positions strictly within each text
    which = np.repeat(np.arange(len(texts)), inner)
    kept = (begin // BLOCK + 1)[which] + np.arange(len(which)) - np.repeat(np.cumsum(inner) - inner, inner)
    stop = np.concatenate([end, kept * BLOCK])
    own = np.concatenate([np.arange(len(texts)), which])
    floor = np.maximum(begin[own], (stop - 1) // BLOCK * BLOCK)
    row = np.concatenate([np.asarray(texts, np.int64), index["rows"][kept].astype(np.int64)])
    out = np.zeros(int(offsets[-1]), np.int64)
    shift = offsets[own] - begin[own]
    live = np.flatnonzero(stop > floor)
    while len(live):
        symbol, row[live] = step(index, row[live])
        stop[live] -= 1
        out[stop[live] + shift[live]] = symbol
        live = live[stop[live] > floor[live]]
    return out, offsets


def save(folder: str, index: dict[str, np.ndarray]) -> None:
    """Write an index below the shared folder."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    for name, a in index.items():
        with fs.open_output_stream(posixpath.join(path, name + ".npy")) as out:
            np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(a))
            out.write(np.ascontiguousarray(a).tobytes())


def load(folder: str) -> dict[str, np.ndarray]:
    """Read one index whole: some bytes a word."""
    fs, path = pafs.FileSystem.from_uri(folder)
    out = {}
    for name in _ARRAYS:
        with fs.open_input_file(posixpath.join(path, name + ".npy")) as f:
            out[name] = np.load(io.BytesIO(f.read()))
    return out
