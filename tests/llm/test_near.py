from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from siftstone.llm.components import components
from siftstone.llm.near import class_pairs, groups, row_pairs, run_sets
from siftstone.llm.shingles import WordHashes, runs, set_keys, sets, word_hashes


def runs_of(code):
    w = re.findall(r"\w+", (code or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def likeness(a, b):
    return Fraction(len(a & b), len(a | b)) if a and b else 0


def corpus(n: int, seed: int, vocabulary: int = 60):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.choice([1, 2, 3, 4, 5, 9, 30, 120]))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            k = r.randrange(len(words) + 1)
            words[k : k + r.choice([0, 1])] = [f"w{r.randrange(vocabulary)}"] * r.choice([0, 1])
        out.append(r.choice([" ", "\n", ", "]).join(words).upper() if r.random() < 0.3 else " ".join(words))
    return out


@pytest.mark.parametrize(("seed", "vocabulary", "threshold"), [(1, 60, 0.7), (2, 4, 0.7), (3, 2000, 0.8), (4, 30, 0.5)])
def test_no_pair_is_lost(spark, seed, vocabulary, threshold):
    codes = [*corpus(160, seed, vocabulary), None, "", "  ;", "one", "One", "one two", "é é é", "É é é"]
    df = spark.createDataFrame([(i, c, 7, 8) for i, c in enumerate(codes)], "id bigint, code string, n int, runs int").repartition(5)
    table = run_sets(df, "id", "code")
    got = {(r["id_a"], r["id_b"]) for r in row_pairs(table, class_pairs(table, threshold)).collect()}
    known = [runs_of(c) for c in codes]
    limit = Fraction(str(threshold))
    assert got == {(i, j) for i, j in combinations(range(len(codes)), 2) if likeness(known[i], known[j]) >= limit}
    by_id = {r["id"]: r for r in groups(table, threshold).collect()}
    assert set(by_id) == {i for i, k in enumerate(known) if k}
    root = {i: i for i in by_id}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in got:
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: r["group_id"] for i, r in by_id.items()} == {i: find(i) for i in by_id}
    for i, r in by_id.items():
        assert r["class_id"] == min(j for j in by_id if known[j] == known[i])
        assert r["n_links"] == len({frozenset(known[j]) for j in by_id if known[j] != known[i] and likeness(known[i], known[j]) >= limit})


def test_hot_class_and_crowded_cell(spark):
    codes = ["the very same code again and again"] * 300 + [f"shared head of all x{i} y{i} z{i} tail" for i in range(300)] + [f"u{i} v{i} q{i} r{i}" for i in range(300)]
    table = run_sets(spark.createDataFrame(list(enumerate(codes)), "id bigint, code string").repartition(6), "id", "code")
    assert row_pairs(table, class_pairs(table)).count() == 300 * 299 // 2


def test_empty_table(spark):
    table = run_sets(spark.createDataFrame([], "id bigint, code string"), "id", "code")
    assert row_pairs(table, class_pairs(table)).count() == 0 and groups(table).count() == 0


def test_very_long_text(spark):
    a = " ".join(f"w{i}" for i in range(150_000))
    table = run_sets(spark.createDataFrame([(1, a), (2, a + " end")], "id bigint, code string"), "id", "code")
    assert class_pairs(table).count() == 1


def test_run_sets_are_those_of_the_definition():
    texts = corpus(80, 9) + ["", "a", "a b", "a b c", "b a c", None]
    h, offsets = sets(*runs(*word_hashes(texts, WordHashes()), 3), len(texts))
    assert np.diff(offsets).tolist() == [len(runs_of(t)) for t in texts]
    keys = set_keys(h, offsets).tolist()
    for i, j in combinations(range(len(texts)), 2):
        assert (keys[i] == keys[j]) == (runs_of(texts[i]) == runs_of(texts[j]))
        shared = len(np.intersect1d(h[offsets[i] : offsets[i + 1]], h[offsets[j] : offsets[j + 1]]))
        assert shared == len(runs_of(texts[i]) & runs_of(texts[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}


def test_rows_without_words_are_classes(spark, tmp_path):
    from siftstone.llm.near import p3_groups

    rows = [(1, "a b c d"), (2, "A b c d"), (3, None), (4, ""), (5, " ; "), (6, "x y z")]
    spark.createDataFrame(rows, "sample_id bigint, code string").write.parquet(str(tmp_path / "dataset_ml_ready.parquet"))
    got = sorted(tuple(r) for r in p3_groups(spark, str(tmp_path)).select("sample_id", "class_id", "group_id", "n_links").collect())
    assert got == [(1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 3, 0), (4, 4, 4, 0), (5, 5, 5, 0), (6, 6, 6, 0)]


def test_coarse_distance_is_a_lower_bound(spark):
    import numpy as np

    from siftstone.llm.near import coarse_counts, coarse_distance

    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    rows = []
    for n in (1, 5, 80, 400, 3000):
        for _ in range(12):
            a = np.unique(r.choice(pool, n))
            b = np.unique(np.concatenate([r.choice(a, max(1, n * 9 // 10)), r.choice(pool, n // 8 + 1)]))
            ca, cb = (int(coarse_counts(x, np.array([0, len(x)])).view(np.int64)[0]) for x in (a, b))
            exact = sum(abs(min(int((a >> np.uint64(60) == k).sum()), 15) - min(int((b >> np.uint64(60) == k).sum()), 15)) for k in range(16))
            rows.append((ca, cb, exact, len(np.setxor1d(a, b))))
    got = spark.createDataFrame(rows, "a bigint, b bigint, exact int, apart int").select(coarse_distance("a", "b").alias("d"), "exact", "apart").collect()
    assert all(x["d"] == x["exact"] <= x["apart"] for x in got)
