from __future__ import annotations

import random
from collections import Counter

import pytest

from siftstone.llm.packing import bucket_bounds, pack, plan_batches


def padding(counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in counts.items())


def test_bounds_are_optimal():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(40):
        counts = {n: r.randrange(1, 50) for n in r.sample(range(1, 40), r.randrange(1, 9))}
        k = r.randrange(1, 5)
        lengths = sorted(counts)
        best = min(padding(counts, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        got = bucket_bounds(counts, k)
        assert len(got) <= k and got[-1] == lengths[-1] and padding(counts, got) == best
    assert bucket_bounds({}, 3) == []


def test_plan_uses_every_item_once():
    bounds, held = [10, 300, 700, 1100, 2048], [1000, 50, 33, 70, 3]
    plan = plan_batches(bounds, held)
    load, items = Counter(), Counter()
    for b, first, each, at, times in plan:
        assert first == items[b]
        items[b] += each * times
        for c in range(at, at + times):
            load[c] += each * bounds[b]
    assert [items[b] for b in range(5)] == held and max(load.values()) <= 2048 and set(load) == set(range(len(load)))


@pytest.mark.parametrize("seed", [1, 2])
def test_pack(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, 0, 1, 5, 300, r.randrange(1, 3000), 2048, 2049, 9000]), "x") for i in range(800)] + [(7, 44, "again"), (7, 44, "again")]
    got = pack(spark.createDataFrame(rows, "id int, n bigint, bucket string"), "id", "n", buckets=32).collect()
    load, tokens, pieces = Counter(), Counter(), {}
    for p in got:
        load[p["container"]] += p["n_tokens"]
        tokens[p["id"]] += p["n_tokens"]
        pieces.setdefault(p["id"], []).append((p["piece_no"], p["first_token"], p["n_tokens"]))
    want = Counter()
    for i, n, _ in rows:
        want[i] += n or 0
    assert max(load.values()) <= 2048 and tokens == +want
    for i, n, _ in rows:
        if n and i != 7:
            assert len(pieces[i]) == -(-n // 2048) and sorted(pieces[i])[-1][1] + sorted(pieces[i])[-1][2] == n
    assert sum(load.values()) / (2048 * len(load)) > 0.95


def test_hot_length_and_nothing(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 1000L else id % 700 + 1 end as n")
    got = pack(df, "id", "n").groupBy("container").sum("n_tokens").collect()
    assert max(r[1] for r in got) <= 2048 and sum(r[1] for r in got) / (2048 * len(got)) > 0.97
    assert pack(df.limit(0), "id", "n").count() == 0 and pack(df.selectExpr("id", "cast(null as bigint) as n"), "id", "n").count() == 0
