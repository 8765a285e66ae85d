"""Parsers, prompts, verifiers and vector kernels."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from heddle.functions import parsers, prompts, vectors, verify
from heddle.functions.text import strip
from heddle.plans.snippets import CALLS


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_edit_with_and_without_path(spark):
    with_path = one(spark, "[src/a.py]\n<search>\na\n<replace>\nb\n<diff_end>", parsers.parse_edits)
    assert [(e.search, e.replace, e.path) for e in with_path] == [("a", "b", "src/a.py")]
    bare = one(spark, "<search>\na\n<replace>\nb\n<diff_end>", parsers.parse_edits)
    assert bare[0].path is None and one(spark, "none", parsers.parse_edits) == []


def test_edits_are_found_as_the_expression_finds_them(spark):
    r = random.Random(5)
    parts = ["<search>", "<replace>", "<diff_end>", "\n", "\n", "\r\n", " ", "\x0b", "[", "]", ":", ".", "..", "a.py", "File", "Path", "===", "src/b", "<", ">", "é", "Target: "]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(3000)]
    head = ["", "x", "\n", "File", "===", "Target", "[", ":", "]", "a.b", "..", ".c", " ", "\n \n", "d-e_f.g", "\x85", "é.ts"]
    texts += ["".join(r.choices(head, k=r.randint(1, 7))) + r.choice(["", "\n", ":\n", "]\n", " \n"]) + "<search>\n1\n<replace>2\r\n<diff_end>" * r.randint(1, 2) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "c string").repartition(4)
    found = lambda k: F.regexp_extract_all("c", F.lit(parsers.EDIT), F.lit(k))
    shown = F.transform(F.arrays_zip(found(2).alias("s"), found(3).alias("r"), found(1).alias("p")), lambda e: F.struct(
        F.replace(e["s"], F.lit("\r\n"), F.lit("\n")).alias("search"), F.replace(e["r"], F.lit("\r\n"), F.lit("\n")).alias("replace"),
        F.nullif(strip(e["p"]), F.lit("")).alias("path")))
    both = df.select("c", parsers.parse_edits("c").alias("got"), shown.alias("want")).cache()
    assert both.where(~F.col("got").eqNullSafe(F.col("want"))).take(3) == []
    assert both.where(F.exists("got", lambda e: e["path"].isNotNull())).count() > 300


def test_long_lines_around_edits_take_no_time(spark):
    line, many = "a b.c " * 40_000, 20_000
    texts = [line, f"{line}\n<search>\nx\n<replace>\ny\n<diff_end>", "<search>" * many + "<replace>" * many, "." * 4 * many + "\n<search>1<replace>2<diff_end>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    began = time.monotonic()
    got = {row["k"]: row for row in df.select("k", parsers.parse_edits("t").alias("e"), parsers.apply_edits(F.lit("x 1"), "t").alias("x")).collect()}
    assert time.monotonic() - began < 30
    assert [len(got[k]["e"]) for k in range(4)] == [0, 1, 0, 1]
    assert got[1]["e"][0].path == line.strip() and got[1]["x"].result == "y 1" and got[3]["x"].result == "x 2" and not got[0]["x"].ok


@pytest.mark.parametrize(
    "source,search,replace,result,error",
    [("x = 1", "1", "2", "x = 2", None), ("x", "y", "z", None, "not found"), ("a a", "a", "b", None, "matched 2 locations"), ("a", "", "b", None, "empty"), ("a\r\nb", "a\nb", "c", "c", None)],
)
def test_apply_edit(spark, source, search, replace, result, error):
    df = spark.createDataFrame([(source, search, replace)], "a string, b string, c string")
    got = df.select(parsers.apply_edit("a", "b", "c").alias("x")).first()["x"]
    assert got.result == result and (error is None) == got.ok
    assert error is None or error in got.error


def test_format_round_trip(spark):
    block = spark.range(1).select(parsers.format_edit(F.lit("a"), F.lit("b"), F.lit("x.py")).alias("t"))
    assert block.select(parsers.apply_edits(F.lit("1 a 2"), F.col("t")).alias("x")).first()["x"].result == "1 b 2"


def test_database_calls(spark):
    df = spark.createDataFrame(CALLS, "id int, p string")
    got = {r["id"]: r["x"] for r in df.select("id", parsers.validate_db_call("p").alias("x")).collect()}
    assert got[0].valid and got[0].table == "users" and got[0].dialect == "postgresql"
    for k, part in {1: "Unsupported SQL dialect 'oracle'", 2: "Unsupported SQL operation 'merge'", 3: "['constraints', 'table']", 4: "Malformed", 5: "JSON object", 6: "non-empty", 7: "non-empty", 8: "None"}.items():
        assert not got[k].valid and part in got[k].error
    assert got[9].valid
    found = one(spark, f"x <db_call>\n{CALLS[0][1]}\n</db_call> y", parsers.parse_db_calls)
    assert len(found) == 1 and found[0].valid


def test_tags_and_code(spark):
    assert one(spark, "<think>a</think>", parsers.check_tags).valid
    assert one(spark, "<think>a", parsers.check_tags).issues == ["Unbalanced tag: 1x <think> vs 0x </think>"]
    assert one(spark, "```js\nq\n``` <code>\n z \n</code>", parsers.extract_code) == "z"
    assert one(spark, "<code></code>", parsers.extract_code) == ""


@pytest.mark.parametrize("prompt,width", [("fix typo", 512), ("Refactor this", 1024), ("an explanation", 1024), ("a" * 251, 1024), ("a\n" * 4, 1024), ("a\n" * 3, 512), ("", 512), (None, 512)])
def test_routing(spark, prompt, width):
    assert one(spark, prompt, prompts.classify_prompt) == width


@pytest.mark.parametrize("token,expected", [("hello", True), (" x", True), ("", False), (" \t", False), (".", False), ("\\", False), ("..", True), (None, False)])
def test_factual(spark, token, expected):
    assert one(spark, token, prompts.is_factual_token) is expected


def test_templates(spark):
    row = spark.range(1).select(
        prompts.agent_prompt(F.lit("s"), F.lit("u")).alias("a"), prompts.wrap_tool_call(F.lit("c"), F.lit("r")).alias("t"),
        prompts.fill_template("{{x}} {topic}", topic=F.lit("y")).alias("f"), prompts.mark_uncertain(F.lit("w"), F.lit(2.0), 1.0).alias("m"),
    ).first()
    assert row["a"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n<think>\n"
    assert row["t"] == "<tool_call>\nc\n</tool_call>\n<tool_response>\nr\n</tool_response>"
    assert row["f"] == "{x} y" and row["m"] == "<uncertain>w"


def test_verifiers():
    assert verify.verify_one("def f(x):\n    return x", "py") == (True, True, False, None, "ast")
    valid, verified, _, error, _ = verify.verify_one("def f(:", "py")
    assert not valid and verified and "SyntaxError" in error
    assert verify.verify_one(" ", "js")[0] is False and verify.verify_one(None, "ts")[4] == "none"
    assert verify.verify_one("f(a[0]);", "js") == (True, False, True, None, "heuristic")
    assert verify.bracket_error("f(]") == "Unbalanced bracket ']' at position 2"
    assert verify.bracket_error("// don't") == "Unterminated string: '"
    assert verify.bracket_error("'\\'") == "Unterminated string: '"
    assert verify.bracket_error("([") == "Unclosed brackets: ['(', '[']"


def test_verify_dispatch(spark):
    df = spark.createDataFrame([("x = 1", " Python "), ("x", "cobol"), (None, "ts")], "c string, l string")
    got = [r[0] for r in df.select(verify.verify_code("c", "l")).collect()]
    assert [g.valid for g in got] == [True, False, False] and "Unsupported" in got[1].error
    flags = df.select(verify.strict_json(F.lit("{}")).alias("a"), verify.strict_json(F.lit("{} x")).alias("b"), verify.pretty_json(F.lit('{"a":"é"}')).alias("p")).first()
    assert flags.a and not flags.b and flags.p == '{\n  "a": "é"\n}'


def test_entropy_and_nucleus(spark):
    kind = "array<double>"
    assert one(spark, [100.0, -100.0, -100.0, -100.0], vectors.entropy, kind) < 0.01
    assert abs(one(spark, [0.0] * 4, vectors.entropy, kind) - math.log(4)) < 1e-9
    assert one(spark, [0.5, 0.3, 0.2], lambda c: vectors.top_p(c, 0.5), kind) == [True, True, False]
    assert one(spark, [0.9, 0.1], lambda c: vectors.top_p(c, 0.0), kind) == [True, False]
    assert one(spark, [1.0, 3.0, 3.0], vectors.argmax, kind) == 1


def test_vector_kernels(spark):
    assert one(spark, [3.0, 4.0], vectors.l2_normalise, "array<float>") == [0.6, 0.8]
    assert one(spark, [[1.0, 2.0], [3.0, 4.0]], lambda c: vectors.pool(c, "mean"), "array<array<double>>") == [2.0, 3.0]
    assert one(spark, [[1.0, 2.0], [3.0, 4.0]], vectors.pool, "array<array<double>>") == [3.0, 4.0]
    assert one(spark, 5, lambda c: vectors.cosine_lr(c, 10, 100, 1.0), "int") == 0.5
    table = one(spark, 2, lambda c: vectors.rotary_table(4, c), "int")
    assert abs(table[0].cos - math.cos(2)) < 1e-12 and abs(table[1].sin - math.sin(0.02)) < 1e-12
