"""URL verdicts from a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path); the longest rule that fits decides.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Words that a label of an unwanted host begins with, and globs for them; they judge urls that no rule fits.
UNWANTED = ("adult", "bets", "casino", "porn")
GLOBS = tuple(("block", f"{before}{word}*") for word in UNWANTED for before in ("", "*.", "*-"))
#: Stands between host and path; no wildcard crosses it, and no UTF-8 text holds it.
BARRIER = 0xFF


@dataclass(frozen=True)
class Automaton:
    """All globs packed side by side into 64-bit words; bit j of a glob means "its first j tokens are read"."""

    step: np.ndarray  # (256, words): states that a byte may enter by one token
    loop: np.ndarray  # (256, words): states that a byte may stay in, those before a ``*``
    start: np.ndarray  # (words,): states before any byte
    final: np.ndarray  # (globs, 2): word and bit of each glob's last state


def compile_globs(globs: list[str | bytes]) -> Automaton:
    """Pack ``globs`` (``*`` any bytes, ``?`` one byte, neither the barrier) over UTF-8 bytes. A ``*`` takes no state of its own."""
    states: list[tuple[set[int] | None, bool]] = []  # (bytes that enter it, None: any; stays on any byte)
    starts, finals = [], []
    for glob in globs:
        starts.append(len(states))
        states.append((set(), False))
        for token in glob.encode() if isinstance(glob, str) else glob:
            if token == ord("*"):
                states[-1] = (states[-1][0], True)
            else:
                states.append((None if token == ord("?") else {token}, False))
        finals.append(len(states) - 1)
    words = max(1, -(-len(states) // 64))
    step, loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start = np.zeros(words, np.uint64)
    for at, (entered, stays) in enumerate(states):
        word, bit = at // 64, np.uint64(1 << (at % 64))
        for byte in set(range(256)) - {BARRIER} if entered is None else entered:
            step[byte, word] |= bit
        if stays:
            loop[:BARRIER, word] |= bit
    for at in starts:
        start[at // 64] |= np.uint64(1 << (at % 64))
    return Automaton(step, loop, start, np.array([(at // 64, at % 64) for at in finals], np.int64).reshape(-1, 2))


def simulate(auto: Automaton, texts: list[bytes]) -> np.ndarray:
    """(texts, globs): which globs match each whole text. All texts advance together, longest first."""
    n, words = len(texts), len(auto.start)
    hits = np.zeros((n, len(auto.final)), bool)
    if not n:
        return hits
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)
    flat, begins = np.frombuffer(b"".join(texts) or b"\0", np.uint8), (ends - sizes)[order]
    state = np.repeat(auto.start[None, :], n, 0)
    alive, falling = n, -sizes[order]
    for at in range(int(sizes.max())):
        alive = int(np.searchsorted(falling, -at, "left"))  # texts with more than ``at`` bytes
        byte = flat[begins[:alive] + at]
        now = state[:alive]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, : words - 1] >> np.uint64(63)  # the carry between words
        state[:alive] = (moved & auto.step[byte]) | (now & auto.loop[byte])
    hits[order] = (state[:, auto.final[:, 0]] >> auto.final[:, 1].astype(np.uint64)) & np.uint64(1) != 0
    return hits


def glob_of(pattern: str) -> bytes:
    """A glob over host and path: what is before the first ``/`` is the host's; without a ``/`` every path will do."""
    host, slash, path = pattern.partition("/")
    return host.encode() + bytes([BARRIER]) + (slash + path if slash else "*").encode()


def rule_globs(rule: str) -> list[bytes]:
    """A rule ``host/path`` fits the host and its subdomains, and every path that begins with its own."""
    if "/" not in rule or any(c in rule for c in "*?"):
        raise ValueError(f"a rule is host/path without wildcards, not {rule!r}")
    return [glob_of(f"{rule}*"), glob_of(f"*.{rule}*")]


def _judge(batches: Iterator[pa.RecordBatch], rules, globs, default: str, block: int) -> Iterator[pa.RecordBatch]:
    patterns = [g for _, rule in rules for g in rule_globs(rule)] + [glob_of(g) for _, g in globs]
    auto = compile_globs(patterns)
    names = np.array([rule for _, rule in rules] + [None], object)
    verdicts = [v for v, _ in rules]
    longest = np.argsort([-len(rule) for _, rule in rules], kind="stable")
    between = bytes([BARRIER])
    for batch in batches:
        for low in range(0, batch.num_rows, block):
            part = batch.slice(low, block)
            urls = zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)
            hit = simulate(auto, [(h or "").encode() + between + (p or "").encode() for h, p in urls])
            rule = np.full(len(hit), len(rules), np.int64)
            for k in longest[::-1]:
                rule[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
            extra = hit[:, 2 * len(rules) :]
            verdict = []
            for i, k in enumerate(rule):
                if k < len(rules):
                    verdict.append(verdicts[k])
                else:
                    first = np.flatnonzero(extra[i])
                    verdict.append(globs[first[0]][0] if len(first) else default)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names[rule].tolist(), pa.string()), pa.array(verdict, pa.string())],
                [*part.schema.names, "rule", "verdict"],
            )


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    globs=GLOBS,
    default: str = "allow",
    *,
    key: str = "page_id",
    url: str = "url",
    block: int = 4096,
) -> DataFrame:
    """Judge every url: the longest of ``rules`` that fits, else the first of ``globs``, else ``default``.

    Rules and globs are (verdict, pattern) pairs; their number is a parameter's, not the data's. The
    canonical url is the host (after the first ``://``, A-Z lower-cased), a barrier that no wildcard
    crosses, and the path up to ``?`` or ``#``. Every rule becomes two globs, all globs share one
    multiword Shift-And automaton, and a block of urls runs through it a byte at a time; what it accepts
    is the verdict. The globs by default block hosts with an unwanted word at the beginning of a part. Null urls and urls without ``://`` have an empty host and
    path and get the default unless a glob matches the empty text. Of rules of equal length the first
    wins. Repeated rows are each judged; an empty table gives an empty result; other columns are not
    read, so clashing names do no harm.

    Returns: key, host, path, rule (null if none), verdict.
    """
    kind = pages.schema[key].dataType.simpleString()
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    canonical = pages.select(
        F.col(key).alias("_k"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")
    )
    rules, globs = tuple(map(tuple, rules)), tuple(map(tuple, globs))
    judged = canonical.mapInArrow(
        lambda it: _judge(it, rules, globs, default, block), f"_k {kind}, host string, path string, rule string, verdict string"
    )
    return judged.withColumnRenamed("_k", key)


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), canonical AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS own, substr(rule, length(split_part(rule, '/', 1)) + 1) AS prefix FROM rules
), fits AS (
  SELECT c.page_id, s.rule, s.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.rule) DESC) AS nth
  FROM canonical c JOIN split s
    ON (c.host = s.own OR ends_with(c.host, '.' || s.own)) AND starts_with(c.path, s.prefix)
)
SELECT c.page_id, c.host, c.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(c.host, '(^|[.-])(adult|bets|casino|porn)') THEN 'block' ELSE 'allow' END) AS verdict
FROM canonical c LEFT JOIN fits f ON f.page_id = c.page_id AND f.nth = 1
"""
