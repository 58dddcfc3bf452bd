from __future__ import annotations

import random

import pytest

from siftstone.llm.sampling import Leaf, Share, allocate, draw, stratum_report

REPORT = "cwe_label string, programming_language string, target_bp int, min_rows int"


def drawn(leaves, size):
    return {p: got.drawn for p, got in allocate({p: Leaf(*v) for p, v in leaves.items()}, size).items()}


def test_unmet_quota_goes_to_siblings_then_cousins():
    leaves = {("a", "x"): (50, 0, 10), ("a", "y"): (10, 0, 100), ("b", "x"): (40, 0, 500)}
    assert drawn(leaves, 100) == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 40}
    leaves["a", "y"] = (10, 0, 20)
    assert drawn(leaves, 100) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 70}
    leaves["b", "x"] = (40, 0, 5)
    assert sum(drawn(leaves, 100).values()) == 35


def test_unmet_quota_is_reported():
    leaves = {("a", "x"): Leaf(50, 0, 10, 50), ("a", "y"): Leaf(10, 0, 100, 10), ("b", "x"): Leaf(40, 60, 41, 60)}
    assert allocate(leaves, 100) == {("a", "x"): Share(10, 40), ("a", "y"): Share(49, 0), ("b", "x"): Share(41, 19)}


def test_minimum_is_kept():
    leaves = {("a", "x"): (9990, 5, 1000), ("b", "x"): (10, 20, 50), ("b", "y"): (0, 3, 2)}
    assert drawn(leaves, 100) == {("a", "x"): 78, ("b", "x"): 20, ("b", "y"): 2}
    assert allocate({}, 10) == {}
    small = drawn(leaves, 10)
    assert sum(small.values()) <= 10 and all(n >= 0 for n in small.values())


def test_allocation_is_exact_and_within_bounds():
    r = random.Random(4)
    for _ in range(300):
        leaves = {(str(r.randrange(4)), str(r.randrange(5))): (r.randrange(1, 90), r.randrange(4), r.randrange(60)) for _ in range(r.randrange(1, 12))}
        size = r.randrange(200)
        got = drawn(leaves, size)
        assert all(0 <= got[p] <= leaves[p][2] for p in leaves)
        assert sum(got.values()) == min(size, sum(a for _, _, a in leaves.values()))
        floors = {p: min(m, a) for p, (_, m, a) in leaves.items()}
        if sum(floors.values()) <= size:
            assert all(got[p] >= floors[p] for p in leaves)


def test_many_strata_are_allocated_in_tasks(spark):
    keys = ("cwe_label", "programming_language")
    targets = spark.range(200_000).selectExpr("concat('l', id div 400) as cwe_label", "concat('p', id % 400) as programming_language", "1 + cast(id % 7 as int) as target_bp", "cast(id % 3 as int) as min_rows")
    rows = spark.range(90_000).selectExpr("concat('l', id % 499) as cwe_label", "concat('p', id % 37) as programming_language")
    report = stratum_report(rows, targets, keys, "target_bp", "min_rows", 10_000)
    total = report.selectExpr("count(*) as n", "sum(allocated) as a", "sum(missing) as m", "max(allocated - available) as over").first()
    assert (total["n"], total["a"]) == (200_000, 10_000) and total["over"] <= 0
    few = targets.where("cwe_label in ('l1', 'l2', 'l3')")
    there, here = (stratum_report(rows, few, keys, "target_bp", "min_rows", 200, on_driver=n) for n in (5, 10_000))
    assert sorted(map(tuple, there.collect())) == sorted(map(tuple, here.collect()))


def test_report_and_draw(spark):
    targets = spark.createDataFrame([("a", "x", 6000, 2), ("b", "x", 4000, 2), ("c", None, 0, 5)], REPORT)
    rows = spark.createDataFrame([(i % 997, "a" if i % 3 else "b", "x", "extra") for i in range(1500)] + [(None, "b", "x", "extra"), (5, "z", None, "no")], "id int, cwe_label string, programming_language string, __n string")
    keys = ("cwe_label", "programming_language")
    report = stratum_report(rows.select(*keys), targets, keys, "target_bp", "min_rows", 300)
    got = {r["cwe_label"]: (r["required"], r["available"], r["allocated"], r["missing"]) for r in report.collect()}
    assert got == {"a": (180, 1000, 180, 0), "b": (120, 501, 120, 0), "c": (5, 0, 0, 5)}
    drawn = draw(rows, report, keys, "id").collect()
    for label, n in (("a", 180), ("b", 120)):
        assert sorted(r["draw_rank"] for r in drawn if r["cwe_label"] == label) == list(range(1, n + 1))
    assert drawn[0]["__n"] == "extra" and len({r["id"] for r in drawn}) > 200
    again = {(r["id"], r["draw_rank"]) for r in draw(rows, report, keys, "id").collect()}
    assert again == {(r["id"], r["draw_rank"]) for r in drawn}


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", "x", 10000, 2)], REPORT)
    rows = spark.createDataFrame([], "id int, cwe_label string, programming_language string")
    keys = ("cwe_label", "programming_language")
    report = stratum_report(rows.select(*keys), targets, keys, "target_bp", "min_rows", 0)
    assert [(r["available"], r["missing"]) for r in report.collect()] == [(0, 2)] and draw(rows, report, keys, "id").count() == 0
    assert stratum_report(rows.select(*keys), targets.limit(0), keys, "target_bp", "min_rows", 5).count() == 0


@pytest.mark.parametrize("share", [0.34, 0.95])
def test_hot_stratum(spark, share):
    rows = spark.range(6000).selectExpr("id", f"case when id < {6000 * share} then 'a' else 'b' end as cwe_label", "'x' as programming_language")
    targets = spark.createDataFrame([("a", "x", 5000, 0), ("b", "x", 5000, 0)], REPORT)
    keys = ("cwe_label", "programming_language")
    report = stratum_report(rows.select(*keys), targets, keys, "target_bp", "min_rows", 1200)
    assert draw(rows, report, keys, "id").count() == 1200
