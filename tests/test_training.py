from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siftstone.operators import augment, curate, evaluate, profile, sampling, vectors, windows
from siftstone.operators.ranks import draw_key, hashed_rank


@pytest.mark.parametrize(("n", "training", "inference"), [(0, 1, 1), (510, 1, 1), (511, 2, 2), (638, 2, 2), (639, 3, 3), (2302, 8, 8), (4080, 8, 8), (4081, 8, 8)])
def test_window_counts(spark, n, training, inference):
    rows = spark.range(1).select(F.size(windows.window_starts(F.lit(n))), F.size(windows.window_starts(F.lit(n), "inference")), windows.window_starts(F.lit(n)))
    a, b, starts = rows.first()
    assert (a, b) == (training, inference)
    if n == 4081:
        assert starts == [i * (n - 510) // 7 for i in range(8)]


def test_windows_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, ["t"] * 700)], "id int, tokens array<string>")
    got = [(r["id"], r["window_no"], r["start"], r["n_tokens"]) for r in windows.token_windows(rows, ["id"]).orderBy("id", "window_no").collect()]
    assert got == [(2, 0, 0, 0), (3, 0, 0, 510), (3, 1, 256, 444), (3, 2, 512, 188)]
    with pytest.raises(ValueError):
        windows.window_starts(F.lit(1), "other")
    raw = windows.raw_windows(spark.createDataFrame([(1, "x" * 50_000), (2, "ab" * 30_000), (3, None)], "id int, code string"), ["id"]).collect()
    assert [(r["id"], r["start"], len(r["chunk"])) for r in raw] == [(2, i * 57_000 // 7, 3000) for i in range(8)]


def test_built_window(spark):
    long, short = spark.createDataFrame([(list(range(600)),), ([7],)], "ids array<int>").select(windows.built(F.col("ids")).alias("w")).collect()
    assert len(long["w"]["input_ids"]) == 512 == sum(long["w"]["attention_mask"]) and long["w"]["input_ids"][-1] == windows.SEP
    assert short["w"]["input_ids"][:4] == [0, 7, 2, 1] and sum(short["w"]["attention_mask"]) == 3


def test_hashed_rank_is_a_permutation(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    got = hashed_rank(rows, ["g"], draw_key("1", F.col("id")), ["id"]).collect()
    for g in ("a", "b", None):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(1, 1001))
    assert hashed_rank(rows.limit(0), ["g"], draw_key("1", F.col("id")), ["id"]).count() == 0
    same = spark.createDataFrame([(1, "a")] * 5, "id int, g string")
    assert sorted(r["rank"] for r in hashed_rank(same, ["g"], draw_key("1", F.col("id")), ["id"]).collect()) == [1, 2, 3, 4, 5]


def test_chunks_are_even(spark):
    rows = sampling.numbered(spark.range(1007), "id").select(sampling.chunk_of(F.col("place"), F.lit(1007), 40).alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in rows) == [25] * 33 + [26] * 7


def test_split_by_group(spark):
    rows = spark.range(400).select("id", F.lit(1).alias("label"), (F.col("id") % 20).cast("string").alias("code"))
    got = sampling.stratified_split(rows, "label", "id", 0.1, group=F.col("code")).groupBy("code").agg(F.count_distinct("part").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r["n"] > 1 for r in got) <= 1


def test_weights_and_resample(spark):
    rows = spark.createDataFrame([(i, 0 if i < 90 else 3) for i in range(100)], "id bigint, label_id bigint")
    w = {r["label_id"]: r["weight"] for r in sampling.class_weights(rows).collect()}
    raw = {i: 100 / (8 * c) for i, c in enumerate([90, 1, 1, 10, 1, 1, 1, 1])}
    assert w == pytest.approx({i: v / (sum(raw.values()) / 8) for i, v in raw.items()})
    drawn = sampling.weighted_resample(rows, "label_id", "id").collect()
    assert len(drawn) == 100 and 30 < sum(r["label_id"] == 3 for r in drawn) < 70
    assert sampling.weighted_resample(rows.limit(0), "label_id", "id").count() == 0
    assert sampling.sampler_weights(rows, "label_id").where("label_id = 3").first()["weight"] == pytest.approx(0.1)


def test_conflicts(spark):
    rows = spark.createDataFrame([("a", "Safe", 1), ("a", "X", 2), ("b", "X", 3), ("b", None, 4), (None, "X", 5), (None, "Y", 6), ("", "X", 7)], "code string, cwe_id string, __n int")
    assert {r["__n"] for r in curate.without_conflicts(rows).collect()} == {3, 4, 5, 6, 7}
    assert curate.without_conflicts(rows.limit(0)).count() == 0


def test_curation_join(spark):
    m = spark.createDataFrame([("c1", None, 1, 1, 1, 1, "True", "f1"), ("c1", None, 1, 1, 1, 1, "True", "f1"), ("c2", "[]", 1, 1, 1, 1, "False", "f1"), ("c3", "[]", 1, 1, 1, 1, "True", None)],
        "code string, parameters string, nloc int, complexity int, token_count int, top_nesting_level int, before_change string, file_change_id string")
    f = spark.createDataFrame([("f1", "C", "h1"), ("f1", "C", "h1"), ("f2", "C", None)], "file_change_id string, programming_language string, hash string")
    x = spark.createDataFrame([("h1", "v1"), ("h1", "v2"), ("h1", "v3")], "hash string, cve_id string")
    c = spark.createDataFrame([("v1", "CWE-1"), ("v2", "CWE-2"), ("v2", "CWE-2")], "cve_id string, cwe_id string")
    got = sorted((r["code"], r["cwe_id"] or "") for r in curate.join_and_label(m, f, x, c).collect())
    assert got == [("c1", ""), ("c1", "CWE-1"), ("c1", "CWE-2"), ("c2", "Safe")]


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "nloc int, complexity int, token_count int, top_nesting_level int")
    assert [r["total"] for r in profile.numeric_summary(empty).collect()] == [None] * 4
    assert [r["r"] for r in profile.correlations(empty).collect()] == [None] * 6


def test_absent_metrics_and_console_lines(spark):
    rows = spark.createDataFrame([("a", 1500, 2.5), ("b", None, 3.5)], "id string, nloc int, other double")
    assert [(r["metric"], r["total"], r["mean_all"]) for r in profile.numeric_summary(rows).collect()] == [("nloc", 1500, 750.0)]
    assert profile.numeric_summary(rows.select("id")).count() == 0 == profile.correlations(rows).count() == profile.long_form(rows.select("id"), ["id"]).count()
    assert profile.long_form(rows, ["id"]).count() == 2
    lines = [r["line"] for r in profile.printed(rows.withColumn("pct", F.lit(12.345)), {"id": 4, "nloc": 7, "other": 6, "pct": 7}).orderBy("id").collect()]
    assert lines == ["a      1,500   2.50  12.35%", "b          -   3.50  12.35%"] or lines == ["a      1,500   2.50  12.34%", "b          -   3.50  12.34%"]
    held = profile.with_domain(profile.value_counts(rows, "id"), "id", ["a", "z"])
    assert {r["id"]: r["n_rows"] for r in held.collect()} == {"a": 1, "z": 0}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 997, 6000])
def test_exact_quantiles(spark, n):
    import random

    import numpy as np

    r = random.Random(n)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 3.0, 3.0, r.random() * 1000, float(r.randrange(40)), -5.5])) for _ in range(n)]
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {x["g"]: x for x in profile.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", fractions).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n_values"] == len(own)
        assert [got[g][f"q{i}"] for i in range(len(fractions))] == pytest.approx(np.quantile(own, fractions).tolist())
    assert len(got) == len({g for g, v in rows if v is not None})


def test_augment_keeps_and_masks(spark):
    code = "int counter = total + query; " * 40
    rows = spark.createDataFrame([(i, code) for i in range(60)] + [(99, None), (98, "")], "id int, code string")
    got = {r["id"]: r for r in augment.augmented(rows, "id").collect()}
    changed = [r for r in got.values() if r["changed"] and r["code"]]
    assert 5 < len(changed) < 40 and got[99]["code"] is None and got[98]["code"] == ""
    for r in changed:
        words = r["code"].split(" ")
        assert words.count("query") == 40 and words.count("int") == 40 and words.count(";") == 40
        assert augment.MASK in words or "var_0" in words
    assert any("var_" in r["code"] for r in changed)
    assert all(r["code"] == code for r in got.values() if r["id"] < 60 and not r["changed"])


def test_rename_ties(spark):
    rows = spark.createDataFrame([(1, "bbb aaa bbb ccc aaa _x_ ab select")], "id int, code string")
    got = [(r["token"], r["n_uses"]) for r in augment.rename_candidates(rows, "id").orderBy("place").collect()]
    assert got == [("bbb", 2), ("aaa", 2), ("ccc", 1), ("_x_", 1)]


def test_pooling(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0]), (1, [4.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "s int, v array<double>")
    get = lambda df: {(r["s"], r["dim"]): r["value"] for r in df.collect()}
    assert get(vectors.pooled(rows, "s", "v", "max")) == {(1, 0): 4, (1, 1): 2, (2, 0): 1, (2, 1): 1}
    assert get(vectors.pooled(rows, "s", "v", "mean")) == {(1, 0): 2, (1, 1): 1, (2, 0): 1, (2, 1): 1}
    att = get(vectors.attention_pooled(rows, "s", "v", [[1.0, 0.0]], [0.0], [1.0]))
    w = math.exp(math.tanh(0.0)), math.exp(math.tanh(4.0))
    assert att[1, 0] == pytest.approx(4 * w[1] / sum(w)) and att[2, 1] == pytest.approx(1)
    with pytest.raises(ValueError):
        vectors.pooled(rows, "s", "v", "median")


def test_softmax_and_loss(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 0.0, 0.0], 0)], "l array<double>, y int")
    got = rows.select(vectors.softmax(F.col("l")).alias("p"), vectors.argmax(F.col("l")).alias("a"), vectors.focal_loss(F.col("l"), F.col("y")).alias("f")).collect()
    p = math.exp(3) / (math.exp(1) + 2 * math.exp(3))
    assert got[0]["p"][1] == pytest.approx(p) and got[0]["a"] == 1 and got[1]["p"] == [1.0, 0.0, 0.0]
    assert got[0]["f"] == pytest.approx((1 - p) ** 2 * -math.log(p)) and got[1]["f"] == pytest.approx(0)


def test_early_stopping(spark):
    series = [0.5, 0.50005, 0.6, 0.59, 0.6, 0.6]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(series)] + [("b", 0, 0.3), ("b", 1, None)], "run string, e int, s double")
    got = {r["run"]: (r["best"], r["best_epoch"], r["stopped_at"]) for r in evaluate.early_stopping(rows, "run", "e", "s").collect()}
    assert got == {"a": (0.6, 2, 5), "b": (0.3, 0, None)}
    assert evaluate.early_stopping(rows.limit(0), "run", "e", "s").count() == 0


def test_trailing_mean_over_blocks(spark):
    rows = spark.range(500).select(F.col("id").alias("step"), (F.col("id") * F.col("id") % 37).cast("double").alias("v"))
    got = {r["step"]: r["mean"] for r in evaluate.trailing_mean(rows, "step", "v", 50, 10, block=70).collect()}
    v = [i * i % 37 for i in range(500)]
    assert got == pytest.approx({i: sum(v[max(0, i - 49) : i + 1]) / min(50, i + 1) for i in range(9, 500, 10)})


def test_report(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, g int")
    counts = evaluate.confusion(rows, "y", "g")
    one = evaluate.overall(counts).first()
    assert one["accuracy"] == 0.5 and one["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    labels = {r["label"]: r for r in evaluate.full_report(counts).collect()}
    assert labels["2"]["precision"] == 0.0 and labels["macro"]["support"] == 4 and labels["weighted"]["recall"] == pytest.approx(0.5)


def test_training_forms_cover_the_corpus(spark, tmp_path):
    from siftstone.plans.training_queries import ON_CORPUS, QUERIES

    rows = [(i, f"select name{i} from users where alpha_{i} " * (i + 1)) for i in range(6)] + [(6, None)]
    spark.createDataFrame(rows, "sample_id bigint, code string").write.parquet(str(tmp_path / "dataset_ml_ready.parquet"))
    for name in ("sliding_windows", "build_window", "ragged_offsets", "augment", "code_tokens", "cache_roundtrip"):
        got = QUERIES[f"corpus_{name}"](spark, str(tmp_path))
        assert {r["sample_id"] for r in got.select("sample_id").collect()} == set(range(6)), name
    assert {f"corpus_{name}" for name in ON_CORPUS} <= set(QUERIES)
