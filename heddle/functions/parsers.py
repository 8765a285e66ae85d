"""Edits, database calls, code blocks and tags inside generated text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.text import WHITE_SPACE, col, let, occurrences, strip, unix_newlines

# The edit format, the code formats, the call schema and the tag pairs.
EDIT = (
    r"(?s)(?:(?:(?:File|Path|Target|===)?\s*[:\[]?([^\n<>\[\]]+\.[a-zA-Z0-9_.-]+)[\]:]?\s*\n))?"
    r"<search>\n?(.*?)\n?<replace>\n?(.*?)\n?<diff_end>"
)
TAGGED_CODE = r"(?s)<code>\n?(.*?)\n?</code>"
FENCED_CODE = r"(?s)```(?:ts|typescript|javascript|js|python|py)?\n(.*?)```"
DB_CALL = r"(?s)<db_call>\n?(.*?)\n?</db_call>"
DIALECTS = ("mariadb", "mysql", "postgresql", "sqlite")
OPERATIONS = ("alter", "create", "delete", "drop", "insert", "select", "update")
REQUIRED_KEYS = ("constraints", "dialect", "operation", "table")
TAGS = ("think", "tool_call", "tool_response", "code")
EDITS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("search", "replace", "path")]))
# The parts of EDIT's optional head: white space, letters of a path's last part, words before it, and the whole head.
_SPACE, _NAME, _WORDS = " \t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-", ("File", "Path", "Target", "===")
_HEAD = re.compile(r"(?:File|Path|Target|===)?[ \t\n\x0b\x0c\r]*[:\[]?([^\n<>\[\]]+\.[a-zA-Z0-9_.-]+)[\]:]?[ \t\n\x0b\x0c\r]*\n\Z")


def _path(gap: str) -> str | None:
    """Path before a block, of the text between it and the block before: what :data:`EDIT` finds there.

    Everything in the optional head has one place: the white space that ends the gap, the line before it, the white space and the
    word before that line. So the place at which the head begins is known, and the expression is tried there only.
    """
    if not gap.endswith("\n"):
        return None
    end = len(gap.rstrip(_SPACE))
    end -= end > 0 and gap[end - 1] in "]:"
    start = max(gap.rfind(c, 0, end) for c in "\n<>[]") + 1
    line = gap[start:end]
    if line.find(".", max(1, len(line.rstrip(_NAME))), len(line) - 1) < 0:
        return None
    if start and gap[start - 1] in "[\n":
        before = gap[: start - (gap[start - 1] == "[")].rstrip(_SPACE)
        start = len(before) - next((len(w) for w in _WORDS if before.endswith(w)), 0)
    found = _HEAD.match(gap, start)
    return found[1].strip(WHITE_SPACE) or None if found else None


def _edits(text: str) -> list[tuple[str, str, str | None]]:
    """(search, replace, path) of each block: the marks are sought one after the other, each from where the last one ended."""
    out, at = [], 0
    while True:
        a = text.find("<search>", at)
        b = text.find("<replace>", a + 8) if a >= 0 else -1
        c = text.find("<diff_end>", b + 9) if b >= 0 else -1
        if c < 0:
            return out
        inner = (text[a + 8 : b], text[b + 9 : c])
        search, replace = (x.removeprefix("\n").removesuffix("\n").replace("\r\n", "\n") for x in inner)
        out.append((search, replace, _path(text[at:a])))
        at = c + 10


@F.udf(EDITS, useArrow=True)
def _parsed(text: str | None) -> list[tuple[str, str, str | None]] | None:
    return None if text is None else _edits(text)


def parse_edits(text: Column | str) -> Column:
    """Edits of a text as an array of (search, replace, path); the path is null where none precedes the block.

    The blocks that :data:`EDIT` finds, in time that grows with the text: as one expression it is tried at every character of a
    line and reads on to the line's end. Only texts with the first mark leave the engine.
    """
    t = col(text)
    marked = F.contains(t, F.lit("<search>"))
    return F.when(marked, _parsed(F.when(marked, t))).when(~marked, F.array().cast(EDITS))


def _applied(source: Column, search: Column, replace: Column) -> Column:
    """One edit of normalised texts: a struct of the result or the error."""

    def checked(count: Column) -> Column:
        at = F.instr(source, search)
        # The built-in replaces every occurrence; there is exactly one here.
        done = F.concat(F.substring(source, F.lit(1), at - 1), replace, F.substring(source, at + F.length(search), F.length(source)))
        error = (
            F.when(search == "", F.lit("Search block is empty."))
            .when(count == 0, F.concat(F.lit("Search block not found in source text.\nSearch block:\n"), search))
            .when(
                count > 1,
                F.concat(
                    F.lit("Search block matched "), count.cast("string"),
                    F.lit(" locations in source text. Must match uniquely to avoid ambiguous edits.\nSearch block:\n"), search,
                ),
            )
        )
        return let(error, lambda e: F.struct(e.isNull().alias("ok"), F.when(e.isNull(), done).alias("result"), e.alias("error")))

    size = F.greatest(F.length(search), F.lit(1))
    return let(((F.length(source) - F.length(F.replace(source, search, F.lit("")))) / size).cast("int"), checked)


def apply_edit(source: Column | str, search: Column | str, replace: Column | str) -> Column:
    """Replace the one occurrence of ``search``: (ok, result, error). None, several and an empty search are errors."""
    texts = F.struct(unix_newlines(source).alias("s"), unix_newlines(search).alias("f"), unix_newlines(replace).alias("r"))
    return let(texts, lambda t: _applied(t["s"], t["f"], t["r"]))


def apply_edits(source: Column | str, edits_text: Column | str) -> Column:
    """Apply every edit of a text in order: (ok, result, error). The first failure ends it; no edit is an error."""
    start = F.struct(col(source).alias("text"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, edit: Column) -> Column:
        tried = let(unix_newlines(acc["text"]), lambda source: _applied(source, edit["search"], edit["replace"]))
        after = let(tried, lambda t: F.struct(F.coalesce(t["result"], acc["text"]).alias("text"), t["error"].alias("error")))
        return F.when(acc["error"].isNotNull(), acc).otherwise(after)

    def run(edits: Column) -> Column:
        end = F.aggregate(edits, start, step)
        none = F.lit("No valid <search>...<replace>...<diff_end> blocks found in diff text.")
        error = F.when(F.size(edits) == 0, none)
        return let(
            end,
            lambda e: F.struct(
                (error.isNull() & e["error"].isNull()).alias("ok"),
                F.when(error.isNull() & e["error"].isNull(), e["text"]).alias("result"),
                F.coalesce(error, e["error"]).alias("error"),
            ),
        )

    return let(parse_edits(edits_text), run)


def format_edit(search: Column | str, replace: Column | str, path: Column | str | None = None) -> Column:
    """An edit block, under its path in brackets where there is one."""
    header = F.lit("") if path is None else F.when(F.coalesce(col(path), F.lit("")) != "", F.concat(F.lit("["), col(path), F.lit("]\n"))).otherwise("")
    return F.concat(header, F.lit("<search>\n"), col(search), F.lit("\n<replace>\n"), col(replace), F.lit("\n<diff_end>"))


def extract_code(text: Column | str) -> Column:
    """The first tagged block, else the first fence, else the whole text; stripped."""
    t = col(text)
    return strip(
        F.when(F.rlike(t, F.lit(TAGGED_CODE)), F.regexp_extract(t, TAGGED_CODE, 1))
        .when(F.rlike(t, F.lit(FENCED_CODE)), F.regexp_extract(t, FENCED_CODE, 1))
        .otherwise(t)
    )


def check_tags(text: Column | str) -> Column:
    """(valid, issues): every opening tag as often as its closing tag; order is not checked."""
    t = F.coalesce(col(text), F.lit(""))
    issues = []
    for name in TAGS:
        opens, closes = occurrences(t, f"<{name}>"), occurrences(t, f"</{name}>")
        issues.append(
            F.when(
                opens != closes,
                F.concat(F.lit("Unbalanced tag: "), opens.cast("string"), F.lit(f"x <{name}> vs "), closes.cast("string"), F.lit(f"x </{name}>")),
            )
        )
    return let(F.array_compact(F.array(*issues)), lambda x: F.struct((F.size(x) == 0).alias("valid"), x.alias("issues")))


def _quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def validate_db_call(payload: Column | str) -> Column:
    """(valid, dialect, operation, table, constraints, error) of a JSON payload; the first failing test names the error.

    JSON is read by the engine: it accepts some texts that a strict parser rejects (single quotes,
    trailing text); :func:`heddle.functions.verify.strict_json` tells them apart.
    """
    raw = strip(F.coalesce(col(payload), F.lit("")))
    at = lambda name: F.get_json_object(raw, f"$.{name}")
    keys = F.json_object_keys(raw)
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED_KEYS)), keys))
    shown = F.concat(F.lit("['"), F.array_join(missing, "', '"), F.lit("']"))
    dialect, operation = (strip(F.lower(F.coalesce(at(n), F.lit("none")))) for n in ("dialect", "operation"))
    table_is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(variant, "$.table", "variant")) == "STRING", F.lit(False))
    error = (
        F.when(variant.isNull(), F.lit("Malformed JSON in db_call."))
        .when(~F.startswith(kind, F.lit("OBJECT")), F.lit("Database call payload must be a JSON object."))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing required keys in db_call: "), shown))
        .when(
            ~dialect.isin(*DIALECTS),
            F.concat(F.lit("Unsupported SQL dialect '"), dialect, F.lit(f"'. Supported dialects: {_quoted(DIALECTS)}")),
        )
        .when(
            ~operation.isin(*OPERATIONS),
            F.concat(F.lit("Unsupported SQL operation '"), operation, F.lit(f"'. Supported operations: {_quoted(OPERATIONS)}")),
        )
        .when(~table_is_text | (strip(F.coalesce(at("table"), F.lit(""))) == ""), F.lit("Table name must be a non-empty string."))
        .when(at("constraints").isNull(), F.lit("'constraints' field cannot be None."))
    )
    return let(
        error,
        lambda e: F.struct(
            e.isNull().alias("valid"),
            F.when(e.isNull(), dialect).alias("dialect"),
            F.when(e.isNull(), operation).alias("operation"),
            F.when(e.isNull(), strip(at("table"))).alias("table"),
            F.when(e.isNull(), at("constraints")).alias("constraints"),
            e.alias("error"),
        ),
    )


def parse_db_calls(text: Column | str) -> Column:
    """Validation results of every call block of a text, as an array."""
    blocks = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(DB_CALL), F.lit(1))
    return F.transform(blocks, validate_db_call)


def format_db_call(payload_json: Column | str) -> Column:
    """A call block around a JSON text."""
    return F.concat(F.lit("<db_call>\n"), F.btrim(col(payload_json), F.lit(WHITE_SPACE)), F.lit("\n</db_call>"))
