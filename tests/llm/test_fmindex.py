from __future__ import annotations

import random

import numpy as np
import pytest

from siftstone.llm import fmindex


def texts_of(r, sigma):
    texts = [[r.randrange(1, sigma + 1) * 7919 for _ in range(r.choice([0, 1, 2, 3, 7, 40, 130, 300]))] for _ in range(r.choice([1, 2, 30]))]
    return texts + [list(t) for t in texts[: r.choice([0, 5])]]


def index_of(texts):
    words = np.array([w for t in texts for w in t], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return fmindex.build(words, offsets, np.arange(len(texts)), np.arange(len(texts)))


@pytest.mark.parametrize("seed", range(18))
def test_search_locate_and_extract(seed):
    r = random.Random(seed)
    texts = texts_of(r, (2, 5, 60)[seed % 3])
    index = index_of(texts)
    for width in (1, 2, 3, 5, 9, 14, 20):
        patterns = []
        for _ in range(25):
            t = r.choice(texts)
            at = r.randrange(max(1, len(t) - width + 1))
            patterns.append(t[at : at + width] if len(t) >= width and r.random() < 0.8 else [r.randrange(1, 62) * 7919 for _ in range(width)])
        symbols = fmindex.symbols_of(index, np.array(patterns, np.uint64).ravel()).reshape(-1, width)
        for p, a, b in zip(patterns, *fmindex.search(index, symbols)):
            want = sorted((k, i) for k, t in enumerate(texts) for i in range(len(t) - width + 1) if t[i : i + width] == p)
            text, place = fmindex.locate(index, np.arange(a, b))
            assert sorted(zip(text.tolist(), place.tolist())) == want
    pick = np.array([r.randrange(len(texts)) for _ in range(10)])
    symbols, at = fmindex.extract(index, pick)
    for k, t in enumerate(pick):
        assert [int(index["vocabulary"][x - 1]) for x in symbols[at[k] : at[k + 1]]] == texts[t]


def test_suffix_order():
    r = random.Random(1)
    for _ in range(40):
        ends, n = r.randrange(1, 5), r.randrange(1, 200)
        text = [r.randrange(ends, ends + 3) for _ in range(n)] + list(range(ends))
        assert fmindex.suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_round_trip_and_size(tmp_path):
    r = random.Random(2)
    base = [[r.randrange(3000) for _ in range(120)] for _ in range(60)]
    index = index_of([[(w if r.random() < 0.98 else r.randrange(3000)) + 1 for w in base[k % 60]] for k in range(600)])
    fmindex.save(f"file://{tmp_path}/shard", index)
    again = fmindex.load(f"file://{tmp_path}/shard")
    assert index.keys() == again.keys() and all((index[k] == again[k]).all() and index[k].dtype == again[k].dtype for k in index)
    assert fmindex.stored_bytes(index) < 5 * 600 * 120
