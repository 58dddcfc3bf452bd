from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftstone.llm.mixing import mix, plan_mix, progress_at, segments, shares

WEIGHTS = "source string, target_share double, max_repeats int"


def rows_of(n, seed):
    r = random.Random(seed)
    names = ["big", "Big ", "BIG", "mid-size", "Mid_Size", "small", None, "other"]
    return [(i, r.choice(names[:3] if i % 3 else names), r.choice([None, 0, 7, 50, 120])) for i in range(n)]


def held_by(rows, x, source):
    own = [r for r in rows if r["source"] == source]
    return sum(r["n_tokens"] for r in own if r["progress"] < x) / sum(r["n_tokens"] for r in own)


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_are_met(spark, seed):
    df = spark.createDataFrame([(*r, 1.0) for r in rows_of(6000, seed)], "id int, source string, n int, progress double")
    weights = spark.createDataFrame([("big", 0.6, 1), ("mid size", 0.3, 2), ("small", 0.1, 4), ("none", 0.0, 1)], WEIGHTS)
    mixed, plan = mix(df, weights, "id", "source", "n")
    got = mixed.collect()
    report = {r["source"]: r for r in shares(mixed, plan).collect()}
    for s, share in (("big", 0.6), ("mid_size", 0.3), ("small", 0.1), ("none", 0.0)):
        assert (report[s]["actual_share"] or 0) == pytest.approx(share, abs=0.01) and report[s]["unmet"] == 0
    assert all(1 <= r["copy_no"] <= {"big": 1, "mid_size": 2, "small": 4}[r["source"]] for r in got)
    assert len({(r["id"], r["copy_no"]) for r in got}) == len(got)
    order = [r["progress"] for r in got]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    for r in plan.where("demand > 0").collect():  # half the way through, a tilted schedule has handed out 1/2 - tilt/4
        assert held_by(got, 0.5, r["source"]) == pytest.approx(0.5 - (r["points"][1]["w"] - 1) / 4, abs=0.04)


def test_given_schedules_are_followed(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(8000)], "id int, source string, n int")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], WEIGHTS)
    points = [("A", 0.0, 0.0), ("A", 0.5, 0.0), ("A", 0.5000001, 2.0), ("A", 1.0, 2.0), ("b", 0.25, 4.0), ("b", 0.75, 0.0), ("b", 2.0, 9.0), ("b", None, 9.0), ("b", 0.9, -1.0), ("z", 0.5, 1.0)]
    got = mix(df, weights, "id", "source", "n", schedules=spark.createDataFrame(points, "source string, x double, weight double"))[0].collect()
    assert held_by(got, 0.499, "a") == 0 and held_by(got, 0.75, "a") == pytest.approx(0.5, abs=0.01)
    assert held_by(got, 0.25, "b") == pytest.approx(0.5, abs=0.01) and held_by(got, 0.5, "b") == pytest.approx(0.875, abs=0.01) and held_by(got, 0.76, "b") == 1


def test_inverse_of_integral(spark):
    r = random.Random(3)
    for _ in range(12):
        xs = sorted({0.0, 1.0, *(round(r.random(), 3) for _ in range(r.randrange(4)))})
        points = [{"x": x, "w": r.choice([0.0, 0.5, 1.0, 3.0])} for x in xs]
        if not any(p["w"] for p in points):
            continue
        rows = spark.createDataFrame([(points, k / 50) for k in range(50)], "p array<struct<x: double, w: double>>, part double")
        for row in rows.select("part", progress_at(segments(F.col("p")), F.col("part")).alias("x")).collect():
            area = whole = 0.0
            for a, b in zip(points, points[1:]):
                width = b["x"] - a["x"]
                whole += width * (a["w"] + b["w"]) / 2
                t = min(1.0, max(0.0, (row["x"] - a["x"]) / width))
                area += width * (a["w"] * t + (b["w"] - a["w"]) * t * t / 2)
            assert area / whole == pytest.approx(row["part"], abs=1e-9)


def planned(spark, targets, supply, budget=None):
    texts = [(s, t // c) for s, (c, t) in supply.items() for _ in range(c)]
    texts = spark.createDataFrame(texts, "source string, n_tokens bigint")
    return {r["source"]: r for r in plan_mix(texts, spark.createDataFrame([(s, *t) for s, t in targets.items()], WEIGHTS), budget).collect()}


def test_plan(spark):
    plan = planned(spark, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.2, 3)}, {"a": (10, 100), "b": (5, 1000)})
    assert plan["a"]["demand"] == 200 == plan["b"]["demand"] and (plan["c"]["demand"], plan["c"]["unmet"]) == (0, 80)
    assert sum(0.5 * (plan[s]["points"][1]["w"] - 1) for s in "ab") == pytest.approx(0)
    larger = planned(spark, {"a": (0.5, 2), "b": (0.5, 1)}, {"a": (10, 100), "b": (5, 1000)}, budget=1000)
    assert (larger["a"]["demand"], larger["a"]["unmet"], larger["b"]["demand"], larger["b"]["unmet"]) == (200, 300, 500, 0)
    assert planned(spark, {}, {}) == {} and planned(spark, {"a": (0.5, 0)}, {"a": (1, 5)})["a"]["demand"] == 0


def test_many_sources(spark):
    df = spark.range(60_000).selectExpr("id", "concat('s', id % 20000) as source", "10 as n")
    weights = spark.range(20_000).selectExpr("concat('S', id) as source", "1 / 20000D as target_share", "1 as max_repeats")
    mixed, plan = mix(df, weights, "id", "source", "n")
    assert plan.count() == 20_000 and mixed.count() == 60_000


def test_nothing(spark):
    df = spark.createDataFrame([], "id int, source string, n int")
    weights = spark.createDataFrame([("a", 1.0, 2)], WEIGHTS)
    mixed, plan = mix(df, weights, "id", "source", "n")
    assert mixed.count() == 0
    assert [(r["n_tokens"], r["actual_share"]) for r in shares(mixed, plan).collect()] == [(0, None)]
    some = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 5)], "id int, source string, n int")
    assert mix(some, weights.limit(0), "id", "source", "n")[0].count() == 0
    assert mix(some, weights, "id", "source", "n")[0].count() == 6
