from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from siftstone.operators.skew import balanced_key_stats, combined, fragment, fragment_plan, replicate

SCHEMA = "k string, form binary, nloc bigint, at timestamp, extra int"


def _rows(n: int, seed: int = 1):
    r = random.Random(seed)
    day = dt.datetime(2031, 1, 1)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.4 else f"k{r.randrange(60)}"
        out.append((key if i % 50 else None, None if i % 11 == 0 else bytes([r.randrange(40)]), None if i % 7 == 0 else r.randrange(99), None if i % 13 == 0 else day + dt.timedelta(hours=r.randrange(999)), i))
    return out


def _plain(rows):
    out = {}
    for key in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == key]
        known = [r[2] for r in own if r[2] is not None]
        out[key] = (len(own), len({r[1] for r in own} - {None}), sum(known) / len(known) if known else None, max((r[3] for r in own if r[3]), default=None))
    return out


@pytest.mark.parametrize("rows", [[], _rows(3), _rows(1500), [("hot", b"x", 1, None, 0)] * 400, [(None, b"x", 1, None, 0)] * 9])
def test_key_stats(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["k"]: (r["n_rows"], r["n_form"], r["mean_nloc"], r["latest_at"]) for r in balanced_key_stats(df, ("k",), "form", "nloc", "at", tasks=4).collect()}
    want = _plain(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0::3] == want[k][0::3] and got[k][1] == want[k][1] and got[k][2] == pytest.approx(want[k][2])


def test_matching_side_joins_once_per_row(spark):
    rows = _rows(1000)
    matching = spark.createDataFrame([("hot", 5), ("k1", 6), ("absent", 7)], "k string, share int")
    got = {r["k"]: (r["n_rows"], r["share"]) for r in balanced_key_stats(spark.createDataFrame(rows, SCHEMA), ("k",), "form", "nloc", "at", matching, tasks=4).collect()}
    want = _plain(rows)
    assert got == {"hot": (want["hot"][0], 5), "k1": (want["k1"][0], 6)}


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id % 500 as string) end as k", "id")
    plan = fragment_plan(df, ("k",), 8)
    assert plan.shards[("hot",)] > 1 and max(plan.loads) < 1.3 * 20_000 / 8
    sizes = fragment(df, plan, df["id"]).rdd.glom().map(len).collect()
    assert sum(sizes) == 20_000 and max(sizes) < 1.4 * 20_000 / 8
    copies = replicate(spark.createDataFrame([("hot", 1), ("7", 1)], "k string, x int"), plan).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in copies} == {"hot": plan.shards[("hot",)], "7": 1}


def test_rows_are_folded_where_they_were_placed(spark):
    """The plan as executed: one move a side, then join and folds without exchange until the shards' results meet."""
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id % 50 as string) end as k", "cast(cast(id as string) as binary) as form", "id as nloc", "timestamp_seconds(id) as at")
    matching = spark.createDataFrame([("hot", 5), ("7", 6)], "k string, share int")
    got = balanced_key_stats(rows, ("k",), "form", "nloc", "at", matching, tasks=8, how="left")
    assert {r["k"]: (r["n_rows"], r["n_form"], r["share"]) for r in got.collect() if r["k"] in ("hot", "7", "8")} == {"hot": (6667, 6667, 5), "7": (267, 267, 6), "8": (267, 267, None)}
    executed = got._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    moves = re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^)]*)", executed)
    assert sorted(kind for kind, _ in moves) == ["hashpartitioning", "shufflepartitionidpassthrough", "shufflepartitionidpassthrough"]
    assert all("__shard" not in by and by.startswith("k#") for kind, by in moves if kind == "hashpartitioning")
    assert "ShuffledHashJoin" in executed and "BroadcastHashJoin" in executed  # the matching side; the plan's own tables


def test_copies_of_one_value_are_combined_before_they_move(spark):
    rows = spark.range(8000).selectExpr("'hot' as k", "cast('same' as binary) as form", "id as nloc", "timestamp_seconds(id) as at")
    folded = combined(rows, ("k",), "form", "nloc", "at")
    assert folded.count() <= 8 and folded.selectExpr("sum(__n)").first()[0] == 8000
    got = balanced_key_stats(rows, ("k",), "form", "nloc", "at", tasks=4).first()
    assert (got["n_rows"], got["n_form"], got["mean_nloc"]) == (8000, 1, 3999.5)
