"""Filters and textbook-quality scores of source documents, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import alnum_count, col, contains_any, is_blank, let, lines, raw_lines, strip

# Allow-lists, limits, markers and weights of the scores.
LICENSES = (
    "mit", "apache-2.0", "apache 2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "0bsd", "wtfpl",
    "artistic-2.0", "eupl-1.2", "lgpl-2.1", "lgpl-3.0", "mpl-2.0",
)
LANGUAGES = ("javascript", "typescript", "python", "vue", "tsx", "jsx", "css", "scss", "html", "markdown", "json", "yaml")
MIN_CHARS, MAX_CHARS, MIN_ALNUM = 100, 100_000, 0.20
TEST_PATHS = ("test_", "_test", "tests/", "__tests__/", "spec.", "spec/", "testing/")
TEST_MARKS = ("import unittest", "import pytest", "from pytest import", "describe(", "it(", "test(", "assert ", "expect(")
VENDOR_PATHS = ("vendor/", "node_modules/", "dist/", "build/", "third_party/", ".min.js", ".min.css")
GENERATED_MARKS = (
    "@generated", "do not edit", "auto-generated", "sourcemappingurl=", "webpackjsonp", "code generated by",
    "automatically generated",
)
BRANCHES = ("if ", "elif ", "else if ", "for ", "while ", "case ", "switch ", "try:", "catch ", "except ", "&&", "||")
FUNCTIONS = ("def ", "function ", "=>", "class ")
MAX_LINE, MAX_MEAN_LINE = 600, 160
OPENERS, CLOSERS, MARKERS = ('"""', "'''", "/*"), ('"""', "'''", "*/"), ("#", "//", "*")


def _listed(c: Column | str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(strip(F.lower(col(c))).isin(*allowed), F.lit(False))


def is_permissive_license(c: Column | str, allowed: tuple[str, ...] = LICENSES) -> Column:
    """Whether a license is on the allow-list; null and empty are not."""
    return _listed(c, allowed)


def is_target_language(c: Column | str, allowed: tuple[str, ...] = LANGUAGES) -> Column:
    return _listed(c, allowed)


def passes_quality_heuristics(content: Column | str) -> Column:
    """Not blank, 100 to 100,000 code points, at least a fifth of them letters or numbers."""
    c = col(content)
    size = F.length(c)
    sized = ~is_blank(c) & (size >= MIN_CHARS) & (size <= MAX_CHARS)
    return F.when(sized, alnum_count(c) / F.greatest(size, F.lit(1)) >= MIN_ALNUM).otherwise(False)


def _starts(x: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.startswith(x, F.lit(p))
    return found


def _ends(x: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.endswith(x, F.lit(p))
    return found


def score_comments(content: Column | str) -> Column:
    """Score of the share of comment lines.

    A line that opens a block counts and, unless it also closes it and has over three characters, leaves
    the block open; inside a block every line counts and a closer ends it. A closing quote on a line of
    its own therefore opens the block anew: the state machine is kept as it is observed.
    """

    def step(acc: Column, x: Column) -> Column:
        opens, closes = _starts(x, OPENERS), _ends(x, CLOSERS)
        inside = acc["b"]
        counted = opens | inside | _starts(x, MARKERS)
        after = F.when(opens, F.when(~closes | (F.length(x) <= 3), F.lit(True)).otherwise(inside)).otherwise(inside & ~closes)
        return F.struct((acc["n"] + counted.cast("int")).alias("n"), after.alias("b"))

    def banded(own: Column) -> Column:
        count = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(False).alias("b")), step, lambda acc: acc["n"])
        share = count / F.size(own)
        return F.when(F.size(own) == 0, 0.0).otherwise(
            let(
                share,
                lambda s: F.when((s >= 0.10) & (s <= 0.45), 1.0)
                .when((s >= 0.04) & (s < 0.10), 0.7)
                .when((s > 0.45) & (s <= 0.70), 0.6)
                .otherwise(0.3),
            )
        )

    return let(lines(F.coalesce(col(content), F.lit(""))), banded)


def score_tests(path: Column | str, content: Column | str) -> Column:
    """1 for a test's path, 0.85 for a test's marks in the content, else 0.5."""
    p, c = F.lower(F.coalesce(col(path), F.lit(""))), F.coalesce(col(content), F.lit(""))
    return F.when(contains_any(p, TEST_PATHS), 1.0).when(contains_any(c, TEST_MARKS), 0.85).otherwise(0.5)


def score_anti_patterns(content: Column | str, path: Column | str) -> Column:
    """0 for vendored, generated or very long lines, 0.1 for long lines on average, else 1."""
    p, c = F.lower(F.coalesce(col(path), F.lit(""))), F.coalesce(col(content), F.lit(""))
    own = raw_lines(c)
    longest = F.array_max(F.transform(own, F.length))
    return (
        F.when(contains_any(p, VENDOR_PATHS), 0.0)
        .when(contains_any(F.lower(c), GENERATED_MARKS), 0.0)
        .when(longest > MAX_LINE, 0.0)
        .when(F.length(c) / F.greatest(F.size(own), F.lit(1)) > MAX_MEAN_LINE, 0.1)
        .otherwise(1.0)
    )


def score_readability(content: Column | str) -> Column:
    """Mean of a score of the share of branching lines and one of lines per function."""

    def scored(own: Column) -> Column:
        n = F.size(own)
        branches = F.size(F.filter(own, lambda x: contains_any(x, BRANCHES))) / F.greatest(n, F.lit(1))
        functions = F.size(F.filter(own, lambda x: contains_any(x, FUNCTIONS)))
        branching = let(branches, lambda b: F.when((b >= 0.03) & (b <= 0.25), 1.0).when(b < 0.03, 0.5).otherwise(0.4))
        sized = let(
            functions,
            lambda f: F.when(f == 0, 0.7).otherwise(
                F.when((n / F.greatest(f, F.lit(1)) >= 5) & (n / F.greatest(f, F.lit(1)) <= 80), 1.0).otherwise(0.6)
            ),
        )
        return F.when(n == 0, 0.0).otherwise((branching + sized) / 2)

    return let(lines(F.coalesce(col(content), F.lit(""))), scored)


def textbook_quality(content: Column | str, path: Column | str, exact_round: bool = False) -> Column:
    """Weighted score in 0 to 1, to three decimals.

    ``exact_round`` rounds the exact binary value, as Python does, instead of half up.
    """
    raw = (
        score_comments(content) * 0.30
        + score_tests(path, content) * 0.20
        + score_anti_patterns(content, path) * 0.25
        + score_readability(content) * 0.25
    )
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return exact_rounded(clamped, 3) if exact_round else F.round(clamped, 3)


def exact_rounded(c: Column, digits: int) -> Column:
    """Nearest multiple of 10 ** -digits to the double's exact binary value, as Python rounds.

    Twice the scaled value is kept as a product and its exact rounding error, so its side of the half is
    known without doubt.
    """
    scale = 10**digits
    spread = c * 134217729.0
    high = spread - (spread - c)
    product = c * (2.0 * scale)
    error = (high * (2.0 * scale) - product) + (c - high) * (2.0 * scale)
    down = F.floor(c * scale)
    side = (product - (down * 2 + 1)) + error
    up = (side > 0) | ((side == 0) & (down % 2 != 0))
    return F.when(up, down + 1).otherwise(down) / scale


def content_hash(content: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(col(content), 256)
