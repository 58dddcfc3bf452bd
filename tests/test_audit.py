from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftstone.engine import Engine
from siftstone.functions.derive import default_filename, label_id, language_key, parameter_count, php_wrapped, rough_metrics
from siftstone.functions.dictionaries import indicators, read_families
from siftstone.operators.audit import indicator_scan, scored, static_rules
from siftstone.operators.report import audited, per_file, reports, risky
from siftstone.operators.segment import functions_of

SNIPPETS = {
    "c_sample": ("cpp", 'void f(char *p) {\n  char b[8];\n  strcpy(b, p);\n  if (b[0] && p) gets(b);\n  sprintf(b, "%s", p);\n}\n'),
    "php_sample": ("php", '$x = shell_exec($_GET["q"]);\n$y = unserialize($x);\n'),
    "py_shell": ("python", "import subprocess\nsubprocess.call(c, shell=True)\nh = md5(c)\n"),
    "alias_py": ("py", "exec(x)\n"),
    "empty": ("python", ""),
    "unicode": ("javascript", "évar = 1;\nvar ñ = opción;\nconst u²eval = 2;\n"),
}
# tags, findings by line, risk, (nloc, tokens, complexity)
GOLDEN = {
    "c_sample": ("gets sprintf strcpy", ["3:HIGH", "4:CRITICAL", "5:MEDIUM"], 1.0, (6, 49, 3)),
    "php_sample": ("shell_exec unserialize", ["1:HIGH", "2:HIGH"], 1.0, (4, 28, 3)),
    "py_shell": ("call md5 shell subprocess", ["2:HIGH", "3:MEDIUM"], 1.0, (3, 18, 1)),
    "alias_py": ("exec", [], 0.15, (1, 4, 1)),
    "empty": ("", [], 0.0, (0, 0, 1)),
    "unicode": ("", ["2:LOW"], 0.4, (3, 14, 1)),
}


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([(k, lang, code) for k, (lang, code) in SNIPPETS.items()] + [("null", "python", None)], "id string, lang string, code string").cache()


def test_goldens(blocks):
    rules = {(r["id"], f"{r['line_no']}:{r['severity']}") for r in static_rules(blocks).collect()}
    rows = {r["id"]: r for r in scored(blocks).collect()}
    tags = {(r["id"], r["token"]) for r in indicator_scan(blocks).collect()}
    for k, (words, findings, risk, _) in GOLDEN.items():
        assert sorted(f for i, f in rules if i == k) == findings
        assert " ".join(rows[k]["tags"]) == words == " ".join(sorted(t for i, t in tags if i == k))
        assert (rows[k]["n_findings"], rows[k]["risk_score"]) == (len(findings), pytest.approx(risk))
    assert (rows["null"]["n_tags"], rows["null"]["n_findings"], rows["null"]["risk_score"]) == (0, 0, 0.0)


def test_rough_metrics(blocks):
    got = {r["id"]: tuple(r["m"]) for r in blocks.select("id", rough_metrics(php_wrapped(F.col("code"), F.col("lang"))).alias("m")).collect() if r["id"] != "null"}
    assert got == {k: v[3] for k, v in GOLDEN.items()}


def test_derivations(spark):
    rows = spark.createDataFrame(
        [("a", " PY ", "Safe", "['x']"), ("b.c", "Java", None, None), (None, None, "CWE-22", "[]"), ("unknown", "js", "x", """["a", 'b, c']""")],
        "f string, l string, c string, p string",
    )
    key = language_key(F.col("l"))
    nested = {
        "[('a', 'int'), ('b', None)]": 2, "(1,)": 1, "()": 0, "[ ]": 0, "[[1, [2, 3]], {'k': [1, 2]}, (4, 5)]": 3, "{'a': 1, 'b': (2, 3)}": 2, "[('it\\'s, [x', 1)]": 1,
        "[('a', 1), ]": 1, "[('a'": 0, "x": 0, "": 0, "5": 0, "[(1, 2)] x": 0, "[('😀,', 1), ('b', 2)]": 2,
    }
    counts = spark.createDataFrame([(k,) for k in nested], "p string").select("p", parameter_count(F.col("p"))).collect()
    assert dict(map(tuple, counts)) == nested
    got = rows.select(default_filename(F.col("f"), key), key, label_id(F.col("c")), parameter_count(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("virtual_file.py", "py", 0, 1), ("b.c", "java", 7, 0), ("virtual_file.txt", "none", 4, 0), ("virtual_file.js", "js", 7, 2)]


def test_vocabulary_is_a_parameter(tmp_path, blocks):
    (tmp_path / "v").write_text("names: OPCIÓN b\nno family\n")
    extra = read_families(str(tmp_path / "v"))
    assert {"opción", "b", "gets"} <= set(indicators(extra))
    got = {r["id"] for r in indicator_scan(blocks, vocabulary=indicators(extra)).where("token = 'opción'").collect()}
    assert got == {"unicode"}


def test_all_indicators_are_bundled(spark):
    assert len(indicators()) == 257
    assert set(indicators()) < set(indicators({"sql": ["zzz"]}))  # a family of the same name adds words
    code = "xml etree dtd\nurlopen fetch curl\npassword apikey token session\nrc4 ecb random\n"
    rows = spark.createDataFrame([("a", "python", code)], "id string, lang string, code string")
    assert scored(rows).first()["tags"] == sorted(code.split())
    assert {r["line_no"]: r["n"] for r in indicator_scan(rows).groupBy("line_no").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 3, 3: 4, 4: 3}


PYTHON = 'import os\n\ndef first(a, b=(1, 2)):\n    """def no(): {"""\n    if a and b:\n        return 1\n    return 2\n\nclass C:\n    async def second(self):\n        pass\n'
JAVA = "class A {\n  int one(int a, Map<K, V> b) {\n    if (a > 0) { return 1; } // }\n    return 2;\n  }\n  void two() {}\n}\n"


def test_segments():
    got = [(f.name, f.start_line, f.end_line, f.parameters, f.complexity) for f in functions_of(PYTHON, "python")]
    assert got == [("first", 3, 7, 2, 3), ("second", 10, 11, 1, 1)]
    got = [(f.name, f.start_line, f.end_line, f.parameters, f.complexity) for f in functions_of(JAVA, "java")]
    assert got == [("one", 2, 5, 2, 2), ("two", 6, 6, 0, 1)]
    assert [f.name for f in functions_of("const f = (a) => {\n return 1\n}\nfunction g() { return 2 }", "javascript")] == ["f", "g"]
    assert [f.name for f in functions_of("def a\n  1\nend\ndef b(x)\n  2\nend\n", "ruby")] == ["a", "b"]
    for text in ("", "{", "}}}}", "def", "def f(", "(" * 5000, "{" * 5000, '"' * 99, "int f(int a) {"):
        for lang in ("python", "c", "ruby", "shell"):
            functions_of(text, lang)


def test_audit_of_files(spark):
    files = spark.createDataFrame([(1, "python", PYTHON), (2, "Java", JAVA), (3, "python", "exec(x)\n"), (4, "c", None), (5, None, "")], "file_id int, programming_language string, code string")
    rows = audited(files, "file_id")
    got = {(r["file_id"], r["function_name"]): r for r in rows.collect()}
    assert set(got) == {(1, "first"), (1, "second"), (2, "one"), (2, "two"), (3, "main_script"), (5, "main_script")}
    main = got[3, "main_script"]
    assert (main["start_line"], main["end_line"], main["findings"][0]["line_no"], main["features"]["complexity"]) == (1, 1, 1, 1.0)
    assert {r["file_id"]: r["total_functions"] for r in per_file(rows, "file_id").collect()} == {1: 2, 2: 2, 3: 1, 5: 1}
    assert audited(files.limit(0), "file_id").count() == 0


def test_engine(spark, tmp_path, capsys):
    from siftstone.operators.scorer import fit_scorer

    files = spark.createDataFrame([(1, "python", PYTHON), (2, "python", "eval(x)")], "file_id int, programming_language string, code string")
    engine = Engine(spark)
    assert engine.status()["model_loaded"] is False
    with pytest.raises(RuntimeError):
        engine.predict(files)
    seen = []
    assert engine.audit(files, notify=lambda df: seen.append(df.first().asDict())).count() == 2
    assert seen == [{"n_files": 2, "n_functions": 3, "n_risky": 0}]
    engine.audit(files, notify=lambda df: 1 / 0)
    assert "division" in capsys.readouterr().out
    data = spark.createDataFrame([("select from where " * 3, 2), ("return x", 0), (None, 1), ("echo html", 1)], "code string, label_id int")
    fit_scorer(data, rounds=2).write().overwrite().save(str(tmp_path / "m"))
    assert engine.reload_model(str(tmp_path / "m"))["model_loaded"]
    out = engine.predict(spark.createDataFrame([("select x",), ("",), (None,)], "code string")).collect()
    assert out[0]["prediction"]["label"] in ("Safe", "CWE-79", "CWE-89") and out[1]["prediction"] is None and out[2]["prediction"] is None


def test_risky_scale(spark):
    rows = spark.createDataFrame([(0.7, None), (0.2, "CWE-79"), (0.2, "N/A"), (0.5, "Safe")], "s double, l string")
    assert [r[0] for r in rows.select(risky(F.col("s"), F.col("l"))).collect()] == [False, True, False, False]
    assert [r[0] for r in rows.select(risky(F.col("s"), F.col("l"), scale=100.0)).collect()] == [True, True, False, False]


def test_reports_by_function(spark):
    bad = "def a(x):\n    exec(x)\n    exec(x)\n\ndef b(y):\n    return y\n\ndef c(z):\n    pickle.load(z)\n    exec(z)\n"
    tags = "def d():\n    select\n    insert\n\ndef e():\n    update\n    drop\n\ndef f():\n    union\n"  # 0.75 as one file, 0.3 at most as functions
    rows = [(1, 1, "one.py", bad), (2, 1, "two.py", tags), (3, 1, None, "def a(x):\n    exec(x)\n    md5(x)\n"), (4, 2, "ok.py", "def g():\n    pass\n")]
    files = spark.createDataFrame([(*r, "python") for r in rows], "file_id int, pr_id int, filename string, code string, programming_language string")
    named = files.withColumn("title", F.concat(F.lit("PR "), F.col("pr_id").cast("string"))).withColumn("at", F.lit("2025-01-02 03:04:05").cast("timestamp"))
    got = {r["pr_id"]: r for r in reports(named.drop("code"), audited(files, "file_id"), ["pr_id"], "file_id", scale=100.0).collect()}
    assert {k: (r["n_files"], r["n_functions"], r["n_risky"]) for k, r in got.items()} == {1: (3, 7, 3), 2: (1, 1, 0)}
    rule = "  - 🔍 *Regla:* General\n"
    assert got[1]["report"] == (
        "# Reporte de Seguridad - PR 1\n**Fecha:** 2025-01-02 03:04:05\n\n## Resumen\n- Total Archivos: 3\n- Total Funciones: 7\n- Hallazgos Críticos: 3\n\n--- \n"
        "## Detalle de Vulnerabilidades\n\n"
        f"## 📂 Archivo: one.py\n- 🔴 **a** (Líneas 1-3)\n  - **Score:** 0.95 | **IA:** Safe\n{rule * 2}- 🔴 **c** (Líneas 8-10)\n  - **Score:** 1.00 | **IA:** Safe\n{rule * 2}\n"
        f"## 📂 Archivo: unknown\n- 🔴 **a** (Líneas 1-3)\n  - **Score:** 1.00 | **IA:** Safe\n{rule * 2}\n"
    )
    head = "🛡️ *Security Audit: PR {}*\n━━━━━━━━━━━━━━━━━━\nEstado: *{}*\n• Archivos: `{}`\n• Vulnerabilidades: `{}`\n"
    assert got[1]["message"] == head.format(1, "⚠️ REVISIÓN REQUERIDA", 3, 3) + "\n👇 _Ver archivo adjunto para detalles._"
    assert got[2]["message"] == head.format(2, "✅ APROBADO", 1, 0)
    assert got[2]["report"].endswith("## Detalle de Vulnerabilidades\n\n🎉 Sin vulnerabilidades detectadas.")


def test_file_metrics_are_parsed(spark):
    from siftstone.operators import segment

    rows = [(1, "python", PYTHON), (2, "Java", JAVA), (3, "python", "exec(x)\n"), (4, "c", None), (5, "c", "bad if\n"), (6, "c", "if\n" * 11)]
    files = spark.createDataFrame(rows, "file_id int, programming_language string, code string")

    def measure(code, language):
        if code.startswith("bad"):
            raise RecursionError
        return (11, 0.0, 11, 0, 0) if code.startswith("if") else segment.measures_of(code, language)

    got = {r["file_id"]: tuple(r)[1:] for r in segment.file_metrics(files, "file_id", measure).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert {k: (got[k][1], *got[k][3:]) for k in (1, 2, 3)} == {1: (2.0, 3, 1, "parser"), 2: (1.5, 2, 1, "parser"), 3: (1.0, 0, 0, "parser")}
    assert got[1][0] == 8 and got[3] == (1, 1.0, 4, 0, 0, "parser")
    assert (got[5], got[6]) == ((1, 2.0, 2, 0, 0, "rough"), (11, 12.0, 11, 0, 0, "rough"))


def test_file_without_functions_keeps_its_row(spark):
    files = spark.createDataFrame([(1, "python", PYTHON), (2, "python", "x")], "file_id int, programming_language string, code string")
    got = per_file(audited(files, "file_id").where("file_id = 1"), "file_id", files=files).collect()  # as if the second could not be parsed
    assert {r["file_id"]: (r["total_functions"], len(r["functions"])) for r in got} == {1: (2, 2), 2: (0, 0)}


def test_responses_and_notifications(spark, capsys):
    import json

    rows = [(1, 1, "one.py", PYTHON, "c1"), (2, 1, "two.py", None, "c1"), (3, 1, "three.py", "exec(x)\nexec(y)\nexec(z)\n", "c1"), (4, 2, "four.py", "x = 1", None), (5, 3, "five.py", "y", "c3")]
    files = spark.createDataFrame(rows, "file_id int, request int, filename string, code string, chat_id string").selectExpr(
        "*", "'python' as programming_language", "concat('PR ', request) as title", "timestamp'2025-01-02 03:04:05' as at"
    )
    seen = []

    def send(chat, message, document, name):
        if chat == "c3":
            raise OSError("no network")
        seen.append((chat, message, document, name))

    got = {r["request"]: r for r in Engine(spark).answer(files, ["request"], notify=send).collect()}
    assert {k: r["total_files_processed"] for k, r in got.items()} == {1: 3, 2: 1, 3: 1}
    body = json.loads(got[1]["response"])
    assert body["total_files_processed"] == 3 and [(f["filename"], f["total_functions"]) for f in body["results"]] == [("one.py", 2), ("three.py", 1)]
    first, main = body["results"][0]["functions"][0], body["results"][1]["functions"][0]
    assert set(first) == {"function_name", "start_line", "end_line", "risk_score", "codebert_prediction", "features", "findings", "tags"} and first["codebert_prediction"] is None
    assert (first["function_name"], first["start_line"], first["features"]["parameters_count"]) == ("first", 3, 2)
    assert [f["line"] for f in main["findings"]] == [1, 2, 3] and main["findings"][0]["severity"] == "HIGH" and main["tags"] == ["exec"] and main["risk_score"] == 1.0
    assert [(c, name) for c, _, _, name in seen] == [("c1", "security_report_030405.md")] and "PR 1" in seen[0][1] and "**Fecha:** 2025-01-02 03:04:05" in seen[0][2]
    said = capsys.readouterr().out
    assert "no chat" in said and "no network" in said


def test_training_artefacts(spark, tmp_path, monkeypatch):
    import json

    from siftstone.engine import setting
    from siftstone.operators.scorer import fit_scorer, model_scorer, predicted, prediction_json, save_if_better, write_history

    data = spark.createDataFrame([("select from where", 2), ("return x", 0)] * 3, "code string, label_id int")
    model = fit_scorer(data, rounds=1)
    best = save_if_better(model, 0.5, None, str(tmp_path / "m"))
    assert best == 0.5 and save_if_better(model, 0.4, best, str(tmp_path / "n")) == 0.5 and (tmp_path / "m").exists() and not (tmp_path / "n").exists()
    write_history(spark, [{"epoch": 1, "loss": 0.5}, {"epoch": 2, "loss": 0.25, "f1": 1}], str(tmp_path / "h"))
    held = [json.loads(x) for x in next((tmp_path / "h").glob("*.json")).read_text().splitlines()]
    assert held == [{"epoch": 1, "loss": 0.5, "f1": None}, {"epoch": 2, "loss": 0.25, "f1": 1}]
    out = predicted(spark.createDataFrame([("select x",), (None,)], "code string"), model_scorer(model)).select("code", prediction_json().alias("j")).collect()
    body = json.loads(next(r["j"] for r in out if r["code"]))
    assert set(body) == {"label", "confidence", "probabilities"} and len(body["probabilities"]) == 8 and next(r["j"] for r in out if not r["code"]) is None
    monkeypatch.setenv("SIFTSTONE_MODEL", "/models/x")
    assert Engine(spark).model_path == "/models/x" and setting(spark, "token") is None
