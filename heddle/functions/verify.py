"""Checks of generated code that need a real parser, as Arrow UDFs; nothing is executed."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("heuristic", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("checker", T.StringType()),
    ]
)
CHECK = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType())])
#: Language tags and their verifiers.
LANGUAGE_TAGS = {"typescript": "ts", "ts": "ts", "javascript": "js", "js": "js", "python": "py", "py": "py"}

# String literals (closed, or open to the end of the code) and single brackets; all else is passed over.
_TOKEN = re.compile(r"""(?s)(?P<quote>["'`])(?:\\.|(?!(?P=quote)).)*+(?P<end>(?P=quote))?|[(){}\[\]]""")
_PARTNER = {a: b for pair in ("()", "{}", "[]") for a, b in (pair, pair[::-1])}


def bracket_error(code: str) -> str | None:
    """First thing wrong with the brackets and strings of JavaScript-like code; comments and regexes are not known.

    One scan finds literals and brackets; each bracket that opens puts its partner on the list of those still due.
    """
    due, unended = [], None
    for token in _TOKEN.finditer(code):
        mark = token[0]
        if token["quote"]:
            unended = None if token["end"] else token["quote"]
        elif mark in "({[":
            due.append(_PARTNER[mark])
        elif not due or due.pop() != mark:
            return f"Unbalanced bracket '{mark}' at position {token.start()}"
    if due:
        return f"Unclosed brackets: {[_PARTNER[mark] for mark in due]}"
    return f"Unterminated string: {unended}" if unended else None


def python_error(code: str) -> str | None:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return f"{type(e).__name__}: {e}"
    return None


def verify_one(code: str | None, language: str) -> tuple[bool, bool, bool, str | None, str]:
    """(valid, verified, heuristic, error, checker) of one snippet; ``verified`` says that a real parser ran."""
    names = {"ts": "TypeScript", "js": "JavaScript", "py": "Python"}
    if not code or not code.strip():
        return False, False, False, f"Empty {names[language]} code snippet.", "none"
    if language == "py":
        error = python_error(code)
        return error is None, True, False, error, "ast"
    error = bracket_error(code)
    return error is None, False, True, error, "heuristic"


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=RESULT.names)


@F.pandas_udf(CHECK)
def check_brackets(code: pd.Series) -> pd.DataFrame:
    """(valid, error): balance of brackets and strings."""
    errors = [bracket_error(c or "") for c in code]
    return pd.DataFrame({"valid": [e is None for e in errors], "error": errors})


@F.pandas_udf(CHECK)
def check_python(code: pd.Series) -> pd.DataFrame:
    """(valid, error): Python syntax."""
    errors = [python_error(c or "") for c in code]
    return pd.DataFrame({"valid": [e is None for e in errors], "error": errors})


@F.pandas_udf(RESULT)
def _verify(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    out = []
    for c, given in zip(code, language, strict=True):
        tag = LANGUAGE_TAGS.get((given or "").strip().lower())
        out.append(verify_one(c, tag) if tag else (False, False, False, f"Unsupported language: {given!r}", "none"))
    return _rows(out)


def verify_code(code: Column | str, language: Column | str) -> Column:
    """Dispatch on a language column; a language without a verifier is an error of the row."""
    return _verify(code, language)


def verify_python(code: Column | str) -> Column:
    return _verify(code, F.lit("python"))


def verify_javascript(code: Column | str) -> Column:
    return _verify(code, F.lit("javascript"))


def verify_typescript(code: Column | str) -> Column:
    return _verify(code, F.lit("typescript"))


@F.pandas_udf(T.BooleanType())
def strict_json(text: pd.Series) -> pd.Series:
    """Whether a text is one JSON value and nothing else."""

    def fine(t: str | None) -> bool:
        try:
            json.loads(t or "")
        except ValueError:
            return False
        return True

    return text.map(fine)


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON indented by two spaces, other letters than ASCII kept; null where it does not parse."""

    def shown(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(shown)
