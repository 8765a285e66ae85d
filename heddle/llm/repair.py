"""Repair of conversation structure: the cheapest edits that make turns alternate, of equals the least in letters.

A conversation is a word of rows, and an edit script a path through layers of four states (nothing yet, after a system row, after
a user row, after an assistant row): Keep, Rerole and Delete lead to the next layer, Insert stays in its own. Costs from the start
and costs to the end say which arcs lie on a cheapest path; the walk through these tight arcs takes the least letter at each step.
A letter leads from a state to one state only, so the frontier of the walk is one node.

Costs go through a row as a 4 x 4 table under (min, +), so a conversation is cut into stretches of rows that are worked on in tasks
of their own: each gives its table, the tables of a conversation give the costs at the stretches' ends, and each stretch is then
walked from every state that lies on a cheapest path. A row is one letter on that way; texts are met again only at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.columns import quoted
from heddle.sources.shared import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A stretch ends at the latest after 2 to this power rows.
STRETCH_BITS = 10
WHITE = " \t\n\x0b\x0c\r"

NONE, BLANK, DUPLICATE, CUT = range(4)
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 40
#: The state after a user or an assistant turn, by the state before; other turns are illegal there.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
#: States in which a conversation may end.
_ENDS = (_START, _ASSISTANT)
_ROLE = {_USER: "u", _ASSISTANT: "a"}
LEGAL = ("su", "ua", "au")

Vector = tuple[int, ...]


def letter(fault: int, initial: str) -> str:
    """One letter for a row's fault and the initial of its role."""
    return chr(97 + 4 * fault + ("sua".index(initial) if initial and initial in "sua" else 3))


@lru_cache(maxsize=None)
def arcs(row: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(action, next state, cost) of a row: D deletes, K keeps, u and a stand for the role that it gets."""
    fault, initial = divmod(ord(row) - 97, 4)
    out = [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        extra, to = TRUNCATED if fault == CUT else 0, _NEXT[state]
        if initial == 0 and state == _START:
            out.append(("K", _SYSTEM, KEEP + extra))
        if initial == to - 1:
            out.append(("K", to, KEEP + extra))
        out.append((_ROLE[to].upper(), to, REROLE + extra))
    return tuple(out)


def _closed(costs: Vector) -> Vector:
    """Costs to the end before inserts of a layer, from those after them. Two inserts reach all that more reach."""
    for _ in range(2):
        costs = tuple(min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4))
    return costs


@lru_cache(maxsize=1 << 16)
def _back(costs: Vector, row: str) -> tuple[Vector, int]:
    """Costs to the end before a row, less their least, and that least."""
    plain = tuple(min(cost + costs[to] for _, to, cost in arcs(row, s)) for s in range(4))
    closed = _closed(plain)
    least = min(closed)
    return tuple(c - least if c < _FAR // 2 else _FAR for c in closed), least


@lru_cache(maxsize=1 << 16)
def _step(state: int, row: str, after: Vector) -> tuple[str, int]:
    """The least letters of a cheapest path from a state to the next layer: inserted roles and the row's action; its state.

    ``after`` are the costs to the end behind the row. Letters in order: D, I, K, R.
    """
    before, least = _back(after, row)
    done = ""
    while True:
        tight = [(a, to) for a, to, cost in arcs(row, state) if cost + after[to] == before[state] + least]
        insert = INSERT + before[_NEXT[state]] == before[state]
        best = min(tight, key=lambda x: "DKUA".index(x[0]), default=None)
        if best and (best[0] == "D" or not insert):
            return done + best[0], best[1]
        state = _NEXT[state]
        done += _ROLE[state]


_ENDING = _closed(tuple(0 if s in _ENDS else _FAR for s in range(4)))


def ending(state: int) -> tuple[str, int]:
    """Roles inserted after the last row."""
    out = ""
    while state not in _ENDS:
        state = _NEXT[state]
        out += _ROLE[state]
    return out, state


@lru_cache(maxsize=1 << 14)
def table_of(rows: str) -> Vector:
    """Least cost of a stretch from each state before it to each state behind it, row by row of the table."""
    out = []
    for to in range(4):
        costs, total = tuple(0 if s == to else _FAR for s in range(4)), 0
        for row in reversed(rows):
            costs, least = _back(costs, row)
            total += least
        out.append([min(c + total, _FAR) for c in costs])
    return tuple(out[to][s] for s in range(4) for to in range(4))


def costs_between(tables: list[Vector]) -> tuple[int, list[tuple[list[int], list[int]]]]:
    """The least cost, and for each stretch those from the start to its first layer and to the end from the layer behind it."""
    through = lambda t, s, to: t[4 * s + to]
    before = [[0, _FAR, _FAR, _FAR]]
    for t in tables:
        before.append([min(min(before[-1][s] + through(t, s, to) for s in range(4)), _FAR) for to in range(4)])
    behind = [list(_ENDING)]
    for t in reversed(tables):
        behind.append([min(min(through(t, s, to) + behind[-1][to] for to in range(4)), _FAR) for s in range(4)])
    behind.reverse()
    return behind[0][_START], [(before[k], behind[k + 1]) for k in range(len(tables))]


@lru_cache(maxsize=1 << 14)
def walks(rows: str, before: Vector, behind: Vector) -> tuple[tuple[int, int, str], ...]:
    """(state before, state behind, actions by row) of a stretch, for every state before it that a cheapest path passes."""
    costs = [behind]
    for row in reversed(rows):
        costs.append(_back(costs[-1], row)[0])
    costs.reverse()
    sums = [before[s] + costs[0][s] for s in range(4)]
    out = []
    for s in range(4):
        if sums[s] == min(sums) and before[s] < _FAR:
            state, done = s, []
            for k, row in enumerate(rows):
                actions, state = _step(state, row, costs[k + 1])
                done.append(actions)
            out.append((s, state, " ".join(done)))
    return tuple(out)


def _less(costs: list[int]) -> Vector:
    """Costs less their least: what is cheapest stays the same."""
    least = min(costs)
    return tuple(c - least if c < _FAR // 2 else _FAR for c in costs)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one conversation after the other; the input is sorted by conversation."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["_c"] != row["_c"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [table_of(r) for r in batch.column("_rows").to_pylist()]
        yield batch.append_column("_table", pa.array(tables, pa.list_(pa.int64())))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_c, _block, _table, _first, _last), sorted, to the costs at each stretch's ends and what its border breaks."""
    kind = pa.struct([("_c", pa.string()), ("_block", pa.int64()), ("_before", pa.list_(pa.int64())), ("_behind", pa.list_(pa.int64())), ("_broken", pa.int64()), ("cost", pa.int64())])
    out = []
    for run in _runs(batches):
        last, (cost, sides) = None, costs_between([r["_table"] for r in run])
        for row, (before, behind) in zip(run, sides, strict=True):
            broken = int(last is not None and last + row["_first"] not in LEGAL)
            out.append({"_c": row["_c"], "_block": row["_block"], "_before": before, "_behind": behind, "_broken": broken, "cost": cost})
            last, cost = row["_last"], 0  # the first stretch has the whole cost
        if len(out) > 4096:
            yield pa.RecordBatch.from_struct_array(pa.array(out, kind))
            out = []
    yield pa.RecordBatch.from_struct_array(pa.array(out, kind))


_WALK = pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("actions", pa.string())])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, before, behind = (batch.column(c).to_pylist() for c in ("_rows", "_before", "_behind"))
        found = [[dict(zip(("before", "behind", "actions"), w, strict=True)) for w in walks(r, _less(a), _less(b))] for r, a, b in zip(rows, before, behind, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("_block"), pa.array(found, pa.list_(_WALK))], ["_c", "_block", "_walks"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_c, _block, _walks), sorted, to the actions of each stretch; the last one's end with the roles inserted behind it."""
    kind = pa.struct([("_c", pa.string()), ("_block", pa.int64()), ("_actions", pa.string()), ("_tail", pa.string())])
    out = []
    for run in _runs(batches):
        state = _START
        for k, row in enumerate(run):
            walk = next(w for w in row["_walks"] if w["before"] == state)
            state, tail = walk["behind"], ""
            if k == len(run) - 1:
                tail, state = ending(state)
            out.append({"_c": row["_c"], "_block": row["_block"], "_actions": walk["actions"], "_tail": tail})
        if len(out) > 4096:
            yield pa.RecordBatch.from_struct_array(pa.array(out, kind))
            out = []
    yield pa.RecordBatch.from_struct_array(pa.array(out, kind))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_c, _chunk), sorted, to a digest of all chunks of a conversation but the line feed in front."""
    own, sha, seen = None, None, False
    done: list[tuple[str, str]] = []
    for batch in batches:
        for c, chunk in zip(batch.column("_c").to_pylist(), batch.column("_chunk").to_pylist(), strict=True):
            if sha is None or c != own:
                if sha is not None:
                    done.append((own, sha.hexdigest()))
                own, sha, seen = c, hashlib.sha256(), False
            if chunk:
                sha.update(chunk.encode("utf-8", "surrogatepass")[0 if seen else 1 :])
                seen = True
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["_c", "repaired_sha256"])
        done = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([sha.hexdigest()])], ["_c", "repaired_sha256"])


def _name(conv: Column) -> Column:
    """A conversation as text that is never null."""
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("_c").sortWithinPartitions("_c", "_block")


def _per_row(actions: Column, role: Column, text: Column) -> Column:
    """The lines that a row becomes, each behind a line feed: inserted turns, then the row itself unless it is deleted."""
    inserted = F.replace(F.replace(F.substring(actions, F.lit(1), F.length(actions) - 1), F.lit("a"), F.lit("\nassistant:")), F.lit("u"), F.lit("\nuser:"))
    own = F.right(actions, F.lit(1))
    name = F.when(own == "K", role).when(own == "U", "user").when(own == "A", "assistant")
    return F.concat(inserted, F.when(own == "D", "").otherwise(F.concat(F.lit("\n"), name, F.lit(":"), text)))


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch_bits: int = STRETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(a report a conversation, its repaired text in chunks) of conversations whose rows go by turn, nulls first.

    Report: ``_c`` (the conversation as text), conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Chunks: ``_c``, ``_block`` (ascending), ``_chunk`` (lines ``role:text``, each behind a line feed). Rows of one turn go by role, then by a hash
    of the text. Null roles and texts are one space; a null conversation is one of its own; other columns are not read; an empty
    table gives no rows. A role that is empty or starts with another letter than s, u and a is legal nowhere.

    No task holds a whole conversation: rows are dealt by ranges of (conversation, turn), and a stretch holds 1,024 rows at most.
    """
    rows = turns.select(
        quoted(conv).alias("_conv"), _name(quoted(conv)).alias("_c"), quoted(turn).alias("_turn"),
        F.coalesce(quoted(role), F.lit(" ")).alias("_role"), F.coalesce(quoted(text), F.lit(" ")).alias("_text"),
    )
    order = ["_c", "_turn", "_role", "_h", "_tie"]
    keyed = rows.withColumns({"_h": F.sha2("_text", 256), "_tie": F.monotonically_increasing_id()})
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    # Written, because a row's place must be the same in all that follows.
    placed = materialise(sorted_rows.withColumn("_pos", F.monotonically_increasing_id()), "repair-rows").withColumn("_block", F.shiftright("_pos", stretch_bits))

    last = F.right(F.rtrim(F.col("_text"), F.lit(WHITE)), F.lit(1))
    firsts = placed.groupBy("_c", "_role", "_h").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("_fresh"))
    narrow = placed.select("_conv", "_c", "_turn", "_block", "_pos", F.left(F.col("_role"), F.lit(1)).alias("_initial"), last.alias("_mark"))
    fault = (
        F.when(F.col("_mark") == "", BLANK).when(F.col("_fresh").isNull(), DUPLICATE).when(~F.col("_mark").isin(".", "!", "?"), CUT).otherwise(NONE)
    )
    coded = narrow.join(firsts, "_pos", "left").withColumn("_fault", fault)
    place = F.when(F.col("_initial") == "s", 0).when(F.col("_initial") == "u", 1).when(F.col("_initial") == "a", 2).otherwise(3)
    code = F.char(97 + 4 * F.col("_fault") + place)
    sequence = F.array_sort(F.collect_list(F.struct("_pos", code.alias("x"), F.col("_initial").alias("i"))))
    pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.concat(a["i"], b["i"]))
    illegal = lambda x: F.when(F.size(x) > 1, F.size(F.filter(pairs(x), lambda p: ~p.isin(*LEGAL)))).otherwise(0)
    counts = [F.count_if(F.col("_fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    grouped = coded.groupBy("_c", "_block").agg(F.first("_conv").alias("_conv"), sequence.alias("_s"), *counts)
    named = grouped.select(
        "_c", "_block", "_conv", "blank", "duplicate", "truncated", illegal(F.col("_s")).cast("long").alias("illegal"),
        F.array_join(F.transform("_s", lambda x: x["x"]), "").alias("_rows"), F.element_at("_s", 1)["i"].alias("_first"), F.element_at("_s", -1)["i"].alias("_last"),
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    stretches = materialise(named.mapInArrow(_tables, fields + ", _table array<long>"), "repair-stretches")

    sides = _in_order(stretches.select("_c", "_block", "_table", "_first", "_last")).mapInArrow(
        _borders, "_c string, _block long, _before array<long>, _behind array<long>, _broken long, cost long"
    )
    borders = materialise(sides, "repair-borders")
    walked = stretches.select("_c", "_block", "_rows").join(borders.select("_c", "_block", "_before", "_behind"), ["_c", "_block"]).mapInArrow(
        _walked, "_c string, _block long, _walks array<struct<before: int, behind: int, actions: string>>"
    )
    actions = materialise(_in_order(walked).mapInArrow(_chained, "_c string, _block long, _actions string, _tail string"), "repair-actions")

    audit = F.concat(F.translate("_actions", "uaUA ", "IIRR"), F.translate("_tail", "ua", "II"))
    by_stretch = stretches.drop("_rows", "_table", "_first", "_last").join(borders, ["_c", "_block"]).join(actions, ["_c", "_block"])
    gaps = placed.groupBy("_c").agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn"), F.lit(0)).cast("long").alias("gaps"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", audit.alias("a")))), lambda x: x["a"]), "")
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "cost")]
    broken = F.sum(F.col("illegal") + F.col("_broken")).alias("illegal")
    report = by_stretch.groupBy("_c").agg(F.first("_conv").alias("conv"), *sums, broken, letters.alias("audit")).join(gaps, "_c")
    texts = placed.groupBy("_c", "_block").agg(F.array_sort(F.collect_list(F.struct("_pos", "_role", "_text"))).alias("_s"))
    both = texts.join(actions, ["_c", "_block"])
    split = F.split("_actions", " ")
    lines = F.array_join(F.transform("_s", lambda x, k: _per_row(F.get(split, k), x["_role"], x["_text"])), "")
    tail = F.replace(F.replace("_tail", F.lit("a"), F.lit("\nassistant:")), F.lit("u"), F.lit("\nuser:"))
    chunks = both.select("_c", "_block", F.concat(lines, tail).alias("_chunk"))
    return report.select("_c", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), chunks


def damage(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults that the checksum of ``conversation:turn`` decides; nulls count as one space.

    Of 20 values 0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes it a user's.
    """
    shown = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = turns.select(quoted(conv).alias("conv_id"), quoted(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("_d"))
    changed = rows.where("_d <> 0").select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "_d",
    )
    return changed.withColumn("_d", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_d")


def repair_digests(turns: DataFrame, *, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """Damaged conversations repaired: a row for every conversation of ``turns``, also for those of which nothing is left.

    Returns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (lines ``role:text``, joined). The
    digest of a conversation is one running checksum, so one task reads its repaired text, a chunk at a time.
    """
    report, chunks = repair(damage(turns), stretch_bits=stretch_bits)
    digests = _in_order(chunks).mapInArrow(_hashed, "_c string, repaired_sha256 string")
    named = turns.select(_name(quoted("conv_id")).alias("_c"), quoted("conv_id").alias("conv_id")).distinct()
    joined = named.join(report.drop("conv"), "_c", "left").join(digests, "_c", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
