"""Filters and scores: the facts of the fixture tables and the edges of every band."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from heddle.functions import curriculum, quality
from heddle.operators import filtering

DOCUMENTED = '"""Adds numbers."""\n\n\ndef add(a, b):\n    # the sum of both\n    if a is None:\n        return b\n    return a + b\n\n\ndef test_add():\n    assert add(1, 2) == 3\n'


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column("c").alias("x")).first()["x"]


@pytest.mark.parametrize("value,expected", [("MIT", True), ("apache-2.0", True), ("BSD-3-Clause", True), ("　mit\t", True), ("GPL-3.0", False), ("AGPL-3.0", False), (None, False), ("", False)])
def test_license(spark, value, expected):
    assert one(spark, value, quality.is_permissive_license) is expected


@pytest.mark.parametrize("value,expected", [("javascript", True), ("TypeScript", True), ("vue", True), ("java", False), ("ruby", False), (None, False)])
def test_language(spark, value, expected):
    assert one(spark, value, quality.is_target_language) is expected


@pytest.mark.parametrize(
    "value,expected",
    [("a" * 100, True), ("a" * 99, False), ("a" * 100_000, True), ("a" * 100_001, False), ("a" * 20 + "." * 80, True), ("a" * 19 + "." * 81, False), (" " * 200, False), ("", False), (None, False)],
)
def test_heuristics(spark, value, expected):
    assert one(spark, value, quality.passes_quality_heuristics) is expected


def machine(content):
    """The comment score's state machine, line by line."""
    lines = [x.strip() for x in content.split("\n") if x.strip()]
    if not lines:
        return 0.0
    n, inside = 0, False
    for x in lines:
        if x.startswith(('"""', "'''", "/*")):
            n += 1
            if not (x.endswith(('"""', "'''", "*/")) and len(x) > 3):
                inside = True
        elif inside:
            n += 1
            if x.endswith(('"""', "'''", "*/")):
                inside = False
        elif x.startswith(("#", "//", "*")):
            n += 1
    r = n / len(lines)
    return 1.0 if 0.10 <= r <= 0.45 else 0.7 if 0.04 <= r < 0.10 else 0.6 if 0.45 < r <= 0.70 else 0.3


def test_comment_machine(spark):
    r = random.Random(3)
    parts = ["x = 1", '"""', '"""doc"""', "/* a", "b */", "*/", "# c", "// d", "* e", "", "  ", "'''", "y()"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", quality.score_comments("c").alias("x")).collect()
    assert all(row["x"] == machine(texts[row["i"]]) for row in rows)


@pytest.mark.parametrize("path,content,expected", [("tests/a.py", "", 1.0), ("a.SPEC.ts", "", 1.0), ("a.py", "import pytest", 0.85), ("a.py", "IMPORT PYTEST", 0.5), (None, None, 0.5)])
def test_test_presence(spark, path, content, expected):
    df = spark.createDataFrame([(path, content)], "p string, c string")
    assert df.select(quality.score_tests("p", "c")).first()[0] == expected


@pytest.mark.parametrize("path,content,expected", [("a.js", "x", 1.0), ("node_modules/a.js", "x", 0.0), ("a", "// @GENERATED", 0.0), ("a", "x" * 601, 0.0), ("a", "x" * 600, 0.1), ("a", "x" * 160, 1.0), ("a", "x" * 161, 0.1)])
def test_anti_patterns(spark, path, content, expected):
    df = spark.createDataFrame([(path, content)], "p string, c string")
    assert df.select(quality.score_anti_patterns("c", "p")).first()[0] == expected


def test_exact_rounding(spark):
    df = spark.createDataFrame([(0.2875,), (0.8125,), (0.0005,), (1.0,), (0.1235,)], "x double")
    got = [r[0] for r in df.select(quality.exact_rounded(F.col("x"), 3)).collect()]
    assert got == [round(x, 3) for x in (0.2875, 0.8125, 0.0005, 1.0, 0.1235)]


def test_complexity_orders(spark):
    assert one(spark, "x = 1", curriculum.code_complexity) < one(spark, "class A:\n    def f(self):\n        if x:\n            for y in z:\n                pass\n", curriculum.code_complexity)
    assert one(spark, [10, 11, 12], curriculum.token_complexity, "array<int>") < one(spark, list(range(100, 200)), curriculum.token_complexity, "array<int>")
    assert one(spark, None, curriculum.token_complexity, "array<int>") == 0.0
    assert one(spark, " \n\t", curriculum.code_complexity) == 0.0


ROWS = [
    (0, DOCUMENTED * 2, "python", "mit"), (1, DOCUMENTED * 2, "java", "mit"), (2, DOCUMENTED * 2, "python", "GPL-3.0"),
    (3, "   ", "python", "mit"), (4, DOCUMENTED * 2, "python", "mit"), (5, None, None, None),
]


def test_filter_reasons(spark):
    df = spark.createDataFrame(ROWS, "i int, content string, lang string, license string")
    flagged = filtering.with_reasons(df, ["i"])
    assert {r["i"]: r["reason"] for r in flagged.collect()} == {0: "accepted", 1: "lang", 2: "license", 3: "quality", 4: "dedup", 5: "lang"}
    stats = filtering.filter_stats(flagged).first().asDict()
    assert stats == {"total": 6, "lang_filtered": 2, "license_filtered": 1, "quality_filtered": 1, "score_filtered": 0, "dedup_filtered": 1, "accepted": 1}
    assert filtering.accepted(flagged).columns == ["content", "lang", "license", "quality_score"]


def test_filter_against_earlier_runs(spark):
    df = spark.createDataFrame(ROWS, "i int, content string, lang string, license string")
    seen = df.where("i = 0").select(quality.content_hash("content").alias("hash"))
    assert filtering.with_reasons(df, ["i"], seen=seen).where("reason = 'accepted'").isEmpty()


def test_min_score(spark):
    df = spark.createDataFrame([(0, DOCUMENTED * 2, "python", "mit", "tests/t.py"), (1, "// @generated\nvar a = 1;\n" * 10, "javascript", "mit", "a.js")], "i int, content string, lang string, license string, path string")
    got = {r["i"]: r["reason"] for r in filtering.with_reasons(df, ["i"], min_score=0.6).collect()}
    assert got == {0: "accepted", 1: "score"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "i int, content string, lang string, license string")
    assert filtering.filter_stats(filtering.with_reasons(df, ["i"])).first()["total"] == 0
