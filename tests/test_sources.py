from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftstone.plans.scratch import materialise, scratch_root
from siftstone.sources import requests as R
from siftstone.streaming import audits


def test_csv_roundtrip(spark, tmp_path):
    rows = [("a,\"b\"\nc\\", "[]", "C", 1, 1.0, 1, 1, "Safe"), ("None", None, "N/A", None, None, 2, 1, None), ("x", "['y']", "C", 1, 1.5, 1, 1, "CWE-1")]
    df = spark.createDataFrame(rows, R.CORPUS)
    R.write_corpus_csv(df, str(tmp_path / "c"))
    R.write_corpus_csv(df.limit(1), str(tmp_path / "c"), "append")
    got = {(r["code"], r["programming_language"], r["cwe_id"]) for r in R.corpus_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {("a,\"b\"\nc\\", "C", "Safe"), (None, None, None), ("x", "C", "CWE-1")}


def test_requests(spark, tmp_path):
    body = {"pr_title": "t", "files": [{"filename": "a.py", "programming_language": "python", "code": "exec(x)"}, {"filename": "b", "code": None}]}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=1))
    got = R.request_files(R.requests(spark, str(tmp_path))).orderBy("file_no").collect()
    assert [(r["filename"], r["programming_language"], r["code"], r["use_model"]) for r in got] == [("a.py", "python", "exec(x)", True), ("b", None, None, True)]


def test_cache(spark, tmp_path):
    R.write_cache(spark.range(100), str(tmp_path / "k"), 5)
    assert R.read_cache(spark, str(tmp_path / "k")).count() == 100 and len(list((tmp_path / "k").glob("*.parquet"))) == 5
    one = next((tmp_path / "k").glob("*.parquet"))
    assert 0 < R.read_cache(spark, str(one)).count() < 100


def test_scratch(spark):
    df = materialise(spark.range(5).withColumn("x", F.lit("é")), "t")
    assert df.count() == 5 and scratch_root(spark).removeprefix("file://") in df.inputFiles()[0]


def test_scratch_on_a_cluster_must_be_named():
    import pytest

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = Conf

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return type("Nothing", (), {"isDefined": staticmethod(lambda: False)})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(type("Session", (), {"sparkContext": Context()}))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"pr_title": str(i), "files": [{"filename": "f", "programming_language": "python", "code": "exec(x)"}]}))
    seen = []
    query = audits.run(audits.scored_stream(audits.request_stream(spark, str(tmp_path / "in"), 1)), lambda df, _: seen.extend(df.select("pr_title", "n_findings").collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in seen) == [("0", 1), ("1", 1), ("2", 1)]


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2031-01-01 00:10:00", "c", 0.5), ("2031-01-01 00:50:00", "c", 1.0), ("2031-01-01 01:10:00", "c", 0.0)], "t string, lang string, risk_score double")
    got = audits.risk_by_window(rows.withColumn("t", F.to_timestamp("t")), "t").orderBy("window").collect()
    assert [(r["n_files"], r["mean_risk"]) for r in got] == [(2, 0.75), (1, 0.0)]
