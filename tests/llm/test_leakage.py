from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siftstone.functions.readings import code_form
from siftstone.llm.leakage import overlap_report, overlaps
from tests.llm.test_near import corpus, likeness, runs_of


@pytest.mark.parametrize(("seed", "shard_words"), [(1, 8_000_000), (2, 400), (3, 60)])
def test_against_brute_force(spark, seed, shard_words):
    codes = [*corpus(170, seed, 40), None, "", ";", "{a: 1, b: 2}", "{b: 2, a: 1}", "one", "ONE", "a b", "a\nb"]
    r = random.Random(seed)
    splits = [r.choice(["train", "train", "val", "test", None, "Train"]) for _ in codes]
    splits[-6:] = ["train", "val", "train", "test", "val", "train"]
    df = spark.createDataFrame([(i, c, s, 1) for i, (c, s) in enumerate(zip(codes, splits))], "id bigint, code string, split string, n int").repartition(4)
    got = {(r["train_id"], r["eval_id"]): r for r in overlaps(df, "id", "code", "split", shard_words=shard_words).collect()}
    known, forms = [runs_of(c) for c in codes], [code_form(c) for c in codes]
    want = {
        (i, j)
        for i, s in enumerate(splits) if s == "train"
        for j, t in enumerate(splits) if t in ("val", "test")
        if (forms[i] and forms[i] == forms[j]) or likeness(known[i], known[j]) * 10 >= 7
    }
    assert set(got) == want
    for (i, j), row in got.items():
        assert row["same_form"] == bool(forms[i] and forms[i] == forms[j])
        if likeness(known[i], known[j]) * 10 >= 7:
            assert row["likeness"] == pytest.approx(float(likeness(known[i], known[j]))) and row["shared"] == len(known[i] & known[j])
            mine, theirs = words_of(codes[i]), words_of(codes[j])
            assert 1 <= row["spans"] and row["longest"] <= max(3, longest_match(mine, theirs))
            if mine == theirs:
                assert row["longest"] == max(3, len(mine))
        else:
            assert row["likeness"] is None and row["spans"] is None


def words_of(code):
    return re.findall(r"\w+", code.lower())


def longest_match(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


def test_report_counts_what_pairs_would(spark):
    codes = [*corpus(150, 5, 40), None, "", "{a: 1, b: 2}", "{b: 2, a: 1}", "x y z", "x y z", "x y z"]
    r = random.Random(5)
    rows = [(i, c, r.choice(["train", "val", "test", None]), r.choice(["p", "q", None]), "L") for i, c in enumerate(codes)]
    rows += [(900 + k, *row[1:]) for k, row in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "id int, code string, split string, source string, label string").repartition(3)
    pairs = overlaps(df, "id", "code", "split").collect()
    want = {}
    for i, _, split, source, label in rows:
        if split in ("val", "test"):
            own = [p for p in pairs if p["eval_id"] == i]
            old = want.get((split, source, label), (0, 0, 0, 0))
            want[split, source, label] = (old[0] + 1, old[1] + bool(own), old[2] + any(p["same_form"] for p in own), old[3] + len(own))
    for words in (2_000_000, 150):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in overlap_report(df, "code", "split", ("split", "source", "label"), shard_words=words).collect()}
        assert got == want
    for none in (df.limit(0), df.where("split = 'train'")):
        assert overlap_report(none, "code", "split", ("split",)).count() == 0


def test_hot_copies_and_nothing(spark):
    df = spark.range(600).selectExpr("id", "case when id % 3 = 0 then 'the same old code' else concat('x', id, ' y', id) end as code", "case when id % 2 = 0 then 'train' else 'val' end as split")
    assert overlaps(df, "id", "code", "split").count() == 100 * 100
    for none in (df.limit(0), df.where("split = 'train'"), df.where("split = 'val'")):
        assert overlaps(none, "id", "code", "split").count() == 0


def test_edges(spark):
    long = " ".join(f"w{i % 4001}" for i in range(60_000))
    rows = [
        (1, long, "train"), (2, long.replace("w7 ", "w8 ", 3), "val"), (None, "a b c d", "train"), (None, "a b c d", "train"), (5, "a b c d", "test"), (5, "a b c d", "test"), (6, None, "val"),
        (7, " \n", "train"), (8, "___", "train"), (9, "___", "val"), (10, "a, b; c D", None), (11, "😀 ; é", "train"), (12, "É", "test"), (13, "a b c", ""),
    ]
    df = spark.createDataFrame(rows, "id int, code string, split string").withColumns({c: F.lit(0) for c in ("class", "words", "entry", "folder", "a", "b", "n", "cut")})
    got = sorted(overlaps(df, "id", "code", "split").select("train_id", "eval_id", "same_form").collect(), key=str)
    want = [(1, 2, False), (8, 9, False), (11, 12, True), *[(None, 5, True)] * 4]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spread = {(r["train_id"], r["eval_id"]): r for r in overlaps(df, "id", "code", "split", shard_words=500).collect()}
    assert spread[1, 2]["spans"] == 1 and 30_000 < spread[1, 2]["longest"] < 60_000  # the text repeats itself, so shifted matches cover the edits


def test_hot_family_is_spread(spark):
    """A third of all rows are variants of one code: they share their rarest runs, and are cut over several shards."""
    base = [f"k{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"v{i % 40}", *base[30:]]) if i % 3 == 0 else f"own{i} text{i} of{i} its{i} own{i}", "train" if i % 2 else "val") for i in range(720)]
    df = spark.createDataFrame(rows, "id int, code string, split string")
    got = {(r["train_id"], r["eval_id"]) for r in overlaps(df, "id", "code", "split", shard_words=200).collect()}
    assert got == {(i, j) for i in range(3, 720, 6) for j in range(0, 720, 6)}
