from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from siftstone.functions.readings import code_form, form_key, weakness_label, with_language
from siftstone.functions.text import nonblank, split_lines, strip, words


@pytest.mark.parametrize(
    ("text", "label"),
    [("safe", "Safe"), (" SAFE\t", "Safe"), ("CWE-0079", "CWE-79"), ("79", "CWE-79"), ("cwe:352", "CWE-352"), ("CWE–89 ", "CWE-89"), ("Cwe 0", "CWE-0"),
     ("nvd-cwe-noinfo", "NVD-CWE-NOINFO"), ("", None), ("  ", None), (None, None), ("x00012", "CWE-12")],
)
def test_label(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(weakness_label(F.col("t"))).first()[0] == label


def test_language(spark):
    aliases = spark.createDataFrame([("c", "C"), ("ansi c", "C"), ("js", "JavaScript"), ("c", "Clash")], "alias_name string, programming_language string")
    rows = spark.createDataFrame([(1, " ANSI C\t", 5), (2, "JS", 5), (3, "plain", 5), (4, None, 5), (5, "C", 5)], "id int, programming_language string, alias_name int")
    got = {r["id"]: (r["language"], r["alias_name"]) for r in with_language(rows, aliases).collect()}
    assert got == {1: ("C", 5), 2: ("JavaScript", 5), 3: (None, 5), 4: (None, 5), 5: ("C", 5)}


def test_form_ignores_layout_case_and_order():
    base = "x = { 'a_1': f, \"b\": 2, .c = 'z' };"
    same = ["X={'A1':F,\n\n\"B\":2,.c='z'}", "x = { .c = 'z',, 'a_1': f, \"b\": 2, }"]
    assert {code_form(s) for s in same} == {code_form(base)}
    for order in permutations(["a: 1", "b: 2", "c: 3"]):
        assert code_form("{" + ", ".join(order) + "}") == "a1b2c3"
    assert code_form("{ f(a, b), c: 1 }") != code_form("{ c: 1, f(a, b) }")  # not all keyed
    assert code_form("{b: 1, a: {d: 1, c: 2}}") == "b1ac2d1"  # only the innermost pair
    assert code_form("a b") != code_form("b a")


@pytest.mark.parametrize("text", [None, "", "  \n", "{}", "/* - */", "_"])
def test_no_form(text):
    assert code_form(text) is None


def test_form_of_any_script():
    assert code_form("Ünï_Ä ٣ ½") == "ünïä٣½"
    assert code_form("{" + ",".join(f"k{i}: {i}" for i in range(50_000)) + "}").startswith("k00")


def test_form_key(spark):
    rows = spark.createDataFrame([("A b",), ("a;B",), (None,), ("!",)], "code string")
    got = [r[0] for r in rows.select(form_key("code")).collect()]
    assert got[0] == got[1] and len(got[0]) == 16 and got[2:] == [None, None]


def test_text_like_python(spark):
    texts = ["", "a\r\nb\rc", "x\n", "\n\n", "a\x0bb\x85c\u2028", "  é_1 Ñ\u00a0\u3000", "\x1c a \x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(split_lines(F.col("t")), strip(F.col("t")), words(F.col("t")), nonblank(split_lines(F.col("t")))).collect()
    for t, r in zip(texts, got):
        assert (r[0], r[1], r[2], r[3]) == (t.splitlines(), t.strip(), re.findall(r"\w+", t.lower()), sum(1 for x in t.splitlines() if x.strip()))
