from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftstone.functions.readings import code_form, form_key
from siftstone.llm.forms import collapse, copies, hot_keys, keyed_table

CASES = {
    "mixed": [(5, "f(a)"), (2, "F( A )"), (9, "f a"), (3, "g"), (8, None), (7, "  "), (6, "{}"), (4, "{b:1, a:2}"), (1, "{ A: 2, 'b': 1, }")],
    "empty": [],
    "hot": [(i, "hot code" if i % 3 else f"code {i}") for i in range(900)],
    "one": [(i, "x") for i in range(50)],
    "repeated": [(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "y")],
    "long": [(1, "ab " * 400_000), (2, "AB" * 400_000), (3, "{" + ",".join(f"k{i}=1" for i in range(30_000)) + "}")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame([(i, c, 1, 2) for i, c in rows], "id int, code string, key int, kept_id int")
    keyed = keyed_table(df, "id", form_key(F.col("code")))
    groups: dict = {}
    for i, c in rows:
        if form := code_form(c):
            groups.setdefault(form, []).append(i)
    two, one = collapse(keyed)
    got = sorted(((r["kept_id"], r["n_copies"]) for r in two.unionByName(one).collect()), key=str)
    least = {f: min((i for i in ids if i is not None), default=None) for f, ids in groups.items()}
    assert got == sorted(((least[f], len(ids)) for f, ids in groups.items()), key=str)
    want = sorted(((least[f], i) for f, ids in groups.items() for i in ids if i != least[f]), key=str)
    assert sorted(((r["kept_id"], r["id"]) for r in copies(keyed).collect()), key=str) == want


def test_hot_keys_are_found_exactly(spark):
    keyed = spark.range(8000).select("id", F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("key"))
    assert [bytes(r[0]) for r in hot_keys(keyed, 16).collect()] == [b"hot"]
    assert hot_keys(keyed.where("id % 3 > 0"), 16).count() == 0


def test_rows_without_a_form_are_records(spark, tmp_path):
    from siftstone.llm.forms import p2_records

    rows = [(1, "a b c d"), (2, "A b c d"), (3, None), (4, ""), (5, " ; "), (6, "x y z")]
    spark.createDataFrame(rows, "sample_id bigint, code string").write.parquet(str(tmp_path / "dataset_ml_ready.parquet"))
    assert sorted(tuple(r) for r in p2_records(spark, str(tmp_path)).select("kept_id", "n_copies").collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1)]
