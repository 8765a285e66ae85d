"""Quality rules: fixed limits, then robust multivariate outliers per language and source. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.columns import quoted
from heddle.sources.shared import materialise

#: Fixed limits: fewest words, and most words in repeated 3-word windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that the minimum-covariance-determinant estimate rests on: half, so that copies of up to nearly half
#: of a group stay outside.
SUPPORT = 0.5
#: Concentration steps that every start takes before the smallest determinant is chosen, the most steps that the chosen one
#: takes after that, and the fall of the logarithm of the determinant that is no longer worth a step.
START_STEPS, STEPS, TOLERANCE = 2, 12, 1e-3
#: Share of normal data that the reweighted estimate takes in.
INSIDE = 0.975
#: Documents that the estimate of a language counts for in that of a source, and that of the table in that of a language.
PRIOR = 50
#: Chance that a document of a normal group lies beyond the cut.
TAIL = 1e-6
#: Smallest spread (standard deviation) of each statistic, the target of the regularised estimate, so that small differences
#: are never held against a document. TAIL lies 5.8 floors out: from none, at 48 % of lines and 21 % of words, so each
#: statistic can reject on its own.
FLOORS = {"word_length": 0.10, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.08}
#: Statistics are kept as integers in units of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1024
#: Bins of the squared distance a doubling; rows of one bin tie.
BINS = 16
#: Groups up to which their estimates are broadcast (about 2 KB each); more are joined by exchange.
BROADCAST_GROUPS = 10_000
#: Files of the small tables at least, and groups of a file.
FEW, GROUPS_A_TASK = 4, 20_000
#: Repeated windows up to which they are looked up one by one; more are found by sorting. Results are the same.
LOOKUPS = 32

_SPACE = r"[\x20\x09-\x0D]+"
_NAMES = tuple(FLOORS)
_DIM = range(len(_NAMES))
_PAIRS = [(i, j) for i in _DIM for j in range(i + 1)]
_X = [f"x{k}" for k in _DIM]
_M = [f"m{k}" for k in _DIM]
_C = [f"c{i}{j}" for i, j in _PAIRS]
_L = [f"l{i}{j}" for i, j in _PAIRS]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    count = F.size(words)
    windows = F.when(
        count >= 3, F.transform(F.sequence(F.lit(0), count - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return _let(
            pairs,
            lambda s: F.sort_array(
                F.transform(F.filter(s, lambda x, k: same(s, x, k + 1) | ((k > 0) & same(s, x, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"])
            ),
        )

    def counted(hashes: Column) -> Column:
        twice = _let(
            F.sort_array(hashes),
            lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))),
        )
        few = lambda t: F.filter(
            F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(t, F.get(hashes, i))
        )
        return _let(twice, lambda t: covered(F.when(F.size(t) <= LOOKUPS, few(t)).otherwise(by_sort(hashes))))

    return _let(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h))
    )


def statistics(docs: DataFrame, *, text: str = "text", keep: dict[str, Column]) -> DataFrame:
    """Columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    A null text has no words. Windows are told apart by 64-bit hashes of their three words.
    """
    t = F.coalesce(quoted(text), F.lit(""))
    words = F.array_remove(F.split(t, _SPACE, -1), "")
    from_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    from_lines = _let(
        F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    made = docs.select(
        *[c.alias(n) for n, c in keep.items()],
        from_words.alias("_w"),
        from_lines.alias("_l"),
        F.size(F.regexp_extract_all(t, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
    )
    flat = made.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return flat.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """The transformed statistics, as integers of 1 / UNIT: a logarithm and three square roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = {
        "word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return [F.floor(values[n] * UNIT + 0.5).cast("long").alias(f"x{k}") for k, n in enumerate(_NAMES)]


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    while high - low > 1e-12 * max(1.0, high):
        middle = (low + high) / 2
        if chi2_cdf(middle, dof) < p:
            low = middle
        else:
            high = middle
    return high


def chi2_cdf(x: float, dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float) -> float:
    """Factor that makes the covariance of the ``share`` nearest of normal data that of all of them."""
    dof = len(_NAMES)
    return share / chi2_cdf(chi2_quantile(share, dof), dof + 2)


def _factored(moments: DataFrame) -> DataFrame:
    """``moments`` with the Cholesky factor (l00 to l33) of the covariance and the logarithm of its determinant (ld)."""
    out = moments
    for j in _DIM:
        left = " - ".join([f"c{j}{j}", *[f"l{j}{k} * l{j}{k}" for k in range(j)]])
        least = (FLOORS[_NAMES[j]] * UNIT) ** 2 * 1e-3
        below = [
            "({}) / l{}{} as l{}{}".format(" - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]]), j, j, i, j)
            for i in range(j + 1, len(_NAMES))
        ]
        out = out.selectExpr("*", f"sqrt(greatest({left}, {least}D)) as l{j}{j}").selectExpr("*", *below)
    return out.selectExpr("*", "2 * ({}) as ld".format(" + ".join(f"ln(l{k}{k})" for k in _DIM)))


def _distance() -> str:
    """Squared Mahalanobis distance: forward substitution with the group's factor."""
    parts: list[str] = []
    for i in _DIM:
        rest = " - ".join([f"x{i} - m{i}", *[f"l{i}{j} * {parts[j]}" for j in range(i)]])
        parts.append(f"(({rest}) / l{i}{i})")
    return " + ".join(f"{p} * {p}" for p in parts)


def _parts(n_groups: int) -> int:
    """Partitions of a table of one row, or a few, a group."""
    return max(FEW, -(-n_groups // GROUPS_A_TASK))


def _groups(passed: DataFrame) -> DataFrame:
    """(g1, g2, feeds): the estimates that a language and source feeds: its own, its language's, the whole table's."""
    about = passed.agg(F.approx_count_distinct(F.struct("g1", "g2"))).first()[0]  # sizes the partitions only
    named = passed.select("g1", "g2").distinct().coalesce(_parts(about)).withColumn("id", F.monotonically_increasing_id())
    first = F.min("id").over(Window.partitionBy("g1"))
    own = materialise(named, "quality-groups")
    return own.select("g1", "g2", F.array(F.col("id") * 2, first * 2 + 1, F.lit(-1).cast("long")).alias("feeds"))


def _with(rows: DataFrame, per_group: DataFrame, n_groups: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table of one row a group, broadcast while its size is bounded."""
    return rows.join(F.broadcast(per_group) if n_groups <= BROADCAST_GROUPS else per_group, ["g1", "g2"], how)


def _under(rows: DataFrame, groups: DataFrame, estimates: DataFrame, n_groups: int) -> DataFrame:
    """Each row once under each estimate that it feeds, with the columns of ``estimates`` (a gid and more)."""
    each = groups.select("g1", "g2", F.explode("feeds").alias("gid")).join(estimates, "gid")
    lists = each.groupBy("g1", "g2").agg(F.collect_list(F.struct(*estimates.columns)).alias("_es"))  # nine at most
    return _with(rows, lists, n_groups).select(*_X, F.explode("_es").alias("_e")).select(*_X, "_e.*")


def _medians(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(gid, m, s): medians and scaled median deviations, from histograms of 64 steps a unit; floors bound the latter."""
    step = UNIT // 64
    fed = _with(rows, groups, n_groups).select(F.explode("feeds").alias("gid"), *_X)
    tall = fed.select("gid", F.posexplode(F.array(*_X)).alias("k", "x"))
    bins = tall.groupBy("gid", "k", F.expr(f"x div {step}").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("gid", "k")
    half = lambda c: F.min(F.when(F.col("cum") * 2 >= F.col("all"), F.col(c)))
    ranked = bins.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    middle = ranked.withColumn("mid", half("bin").over(w)).withColumn("off", F.abs(F.col("bin") - F.col("mid")))
    spread = (
        middle.withColumn("cum", F.sum("n").over(w.orderBy("off")))
        .groupBy("gid", "k")
        .agg((F.max("mid") * step + step / 2).alias("m"), (half("off") * step * 1.4826).alias("s"))
    )
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return spread.groupBy("gid").agg(
        *[pick(k, "m").alias(f"m{k}") for k in _DIM],
        *[F.greatest(pick(k, "s"), F.lit(FLOORS[n] * UNIT)).alias(f"s{k}") for k, n in enumerate(_NAMES)],
    )


def _starts(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Three deterministic first estimates of each group, all at its medians, scaled by its median deviations.

    Start 0 has no correlation, start 1 that of the spatial signs, start 2 that of the hyperbolic tangents; each bounds
    what a far row can do. Products are summed as integers, so sums do not depend on their order.
    """
    medians = materialise(_medians(rows, groups, n_groups).coalesce(_parts(n_groups)), "quality-medians")
    scaled = _under(rows, groups, medians, n_groups).selectExpr("gid", *[f"(x{k} - m{k}) / s{k} as z{k}" for k in _DIM])
    norm = "sqrt(greatest({}, 1e-12D)) as r".format(" + ".join(f"z{k} * z{k}" for k in _DIM))
    bent = scaled.selectExpr("*", norm).selectExpr("gid", *[f"z{k} / r as u{k}" for k in _DIM], *[f"tanh(z{k}) as t{k}" for k in _DIM])
    whole = [F.expr(f"double(sum(bigint(round({a}{i} * {a}{j} * 1048576)))) as {a}{i}{j}") for a in "ut" for i, j in _PAIRS]
    sums = bent.groupBy("gid").agg(*whole)

    def scatter(number: int, a: str) -> str:
        def entry(i: int, j: int) -> str:
            if i == j:
                return f"s{i} * s{i}"
            if not a:
                return "0D"
            return f"coalesce(0.95D * s{i} * s{j} * try_divide({a}{i}{j}, sqrt({a}{i}{i} * {a}{j}{j})), 0D)"

        return "named_struct('start', {}, {})".format(number, ", ".join(f"'c{i}{j}', {entry(i, j)}" for i, j in _PAIRS))

    kinds = "inline(array({}, {}, {}))".format(scatter(0, ""), scatter(1, "u"), scatter(2, "t"))
    return _factored(sums.join(medians, "gid").selectExpr("gid", *_M, kinds))


#: Partial sums of a set of rows: count, sums and products.
_SUMS = {"c": "count(1)"} | {f"p{i}": f"sum(x{i})" for i in _DIM} | {f"q{i}{j}": f"sum(x{i} * x{j})" for i, j in _PAIRS}


def _sums() -> list[Column]:
    return [F.expr(f"{e} as {n}") for n, e in _SUMS.items()]


def _moments(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and covariances of some partial sums: scaled for consistency, with the floors on the diagonal."""
    total = sums.groupBy(*keys).agg(F.max("n").alias("n"), *[F.expr(f"double(sum(cast({c} as decimal(20, 0)))) as {c}") for c in _SUMS])
    means = total.selectExpr("*", *[f"p{i} / c as m{i}" for i in _DIM])
    floor = [(FLOORS[n] * UNIT) ** 2 for n in _NAMES]
    cov = [f"(q{i}{j} / c - m{i} * m{j}) * {scale}D + {floor[i] if i == j else 0.0}D as c{i}{j}" for i, j in _PAIRS]
    return means.selectExpr(*keys, "n", *_M, *cov)


def _concentrate(rows: DataFrame, groups: DataFrame, estimates: DataFrame, n_groups: int) -> DataFrame:
    """One step: mean and covariance of the SUPPORT of each group that lies nearest under each of its estimates.

    Moments are summed by estimate and by bin of the logarithmic distance, so one pass with partial sums finds both
    the nearest rows and their moments; ties in a bin stay together.
    """
    placed = _under(rows, groups, estimates.select("gid", "start", *_M, *_L), n_groups)
    bins = placed.groupBy("gid", "start", F.expr(f"floor(log2({_distance()} + 1) * {BINS}) as bin")).agg(*_sums())
    w = Window.partitionBy("gid", "start")
    near = (
        bins.withColumn("n", F.sum("c").over(w))
        .withColumn("before", F.sum("c").over(w.orderBy("bin")) - F.col("c"))
        .where(F.col("before") < F.ceil(F.col("n") * SUPPORT))
    )
    return _factored(_moments(near, ["gid", "start"], consistency(SUPPORT))).coalesce(_parts(n_groups))


def _reweighted(rows: DataFrame, groups: DataFrame, estimates: DataFrame, n_groups: int) -> DataFrame:
    """Mean and covariance of all rows that the concentrated estimate holds to be inside; n counts all rows."""
    placed = _under(rows, groups, estimates.select("gid", *_M, *_L), n_groups)
    inside = f"{_distance()} <= {chi2_quantile(INSIDE, len(_NAMES))}D as _in"
    sums = placed.groupBy("gid", F.expr(inside)).agg(*_sums())
    all_rows = sums.withColumn("n", F.sum("c").over(Window.partitionBy("gid"))).where("_in")
    return _moments(all_rows, ["gid"], consistency(INSIDE)).coalesce(_parts(n_groups))


def _smallest(estimates: DataFrame, n_groups: int) -> DataFrame:
    """Of each group's estimates that with the smallest determinant."""
    least = F.min_by(F.struct(*estimates.columns), F.struct("ld", "start")).alias("_b")
    return estimates.groupBy("gid").agg(least).select("_b.*").coalesce(_parts(n_groups))


def mcd(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(gid, start, n, m, c, l, ld): the concentrated minimum-covariance-determinant estimate of each group.

    Of the three starts the one with the smallest determinant after START_STEPS steps goes on until no group's determinant
    falls by more than TOLERANCE (of its logarithm); steps never enlarge it but by the ties of a bin, so STEPS bounds a
    slow end only.
    """
    estimates = _starts(rows, groups, n_groups)
    for _ in range(START_STEPS):
        estimates = materialise(_concentrate(rows, groups, estimates, n_groups), "quality-estimates")
    best = materialise(_smallest(estimates, n_groups), "quality-estimates")
    for _ in range(STEPS):
        further = materialise(_concentrate(rows, groups, best, n_groups), "quality-estimates")
        gain = further.select("gid", "ld").join(best.select("gid", F.col("ld").alias("_was")), "gid")
        gained = gain.agg(F.max(F.col("_was") - F.col("ld"))).first()[0]  # one number
        if gained is None or gained <= TOLERANCE:
            break
        best = materialise(_smallest(best.unionByName(further), n_groups), "quality-estimates")
    return best


def _own(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """(g1, g2, m, l): the estimate that judges each language and source.

    The source's estimate and its language's are averaged by documents, the latter counting for PRIOR, and the
    language's with the table's in the same way: one rule at every size, under which a source of a few documents is
    judged by its language and a large one by itself.
    """
    out = groups
    for level in range(3):
        own = [F.col(c).alias(f"{c}_{level}") for c in ("gid", "n", *_M, *_C)]
        out = out.join(estimates.select(*own), F.expr(f"feeds[{level}] = gid_{level}"), "left")

    def shrunk(level: int, name: str) -> str:
        if level == 2:
            return f"{name}_2"
        return f"(({name}_{level} * n_{level} + {shrunk(level + 1, name)} * {PRIOR}) / (n_{level} + {PRIOR}))"

    return _factored(out.selectExpr("g1", "g2", *[f"{shrunk(0, n)} as {n}" for n in (*_M, *_C)])).select("g1", "g2", *_M, *_L)


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", keep=None) -> DataFrame:
    """Per document the base statistics, whether the fixed limits fail it, and whether it is kept.

    Among the documents that pass the limits, the minimum-covariance-determinant location and scatter of the
    transformed statistics are estimated from all rows, per language and source, per language, and for the table:
    three deterministic starts, concentration on the nearest SUPPORT, the smallest determinant, reweighting. FLOORS is
    added to the scatter, so a group whose statistics hardly vary does not reject its neighbours, and each group's
    estimate is averaged with its language's and the table's (PRIOR), so that every document is judged. A document
    beyond the chi-square quantile of 1 - TAIL of its group's squared distances is rejected.

    Null languages and sources count as empty ones. A group of any size is only ever summed partially; rows that tie are
    treated alike. Null and empty texts fail the limits. Repeated rows each get a result, an empty table an empty one.
    Other columns are read only if ``keep`` names them. Windows of three words are told apart by 64-bit hashes: in a text
    of a million words two different ones agree with a chance of 3e-8.

    Returns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; with ``keep`` those
    columns follow the key.
    """
    own = {"_k": quoted(key)} | (keep or {})
    named = {"g1": F.coalesce(quoted(lang), F.lit("")), "g2": F.coalesce(quoted(source), F.lit(""))}
    counted = statistics(docs, text=text, keep=own | named)
    table = materialise(counted.select("*", *_vector()), "quality-statistics")
    passed = table.where("not base_failed").select("g1", "g2", *_X)
    groups = _groups(passed)
    n_groups = groups.count()
    found = mcd(passed, groups, n_groups)
    final = materialise(_reweighted(passed, groups, found, n_groups), "quality-estimates")
    judges = materialise(_own(groups, final).coalesce(_parts(n_groups)), "quality-judges")
    cut = chi2_quantile(1 - TAIL, len(_NAMES))
    outlier = F.expr(f"coalesce({_distance()} > {cut}D, false)")
    judged = _with(table, judges, n_groups, "left")
    return judged.select(
        F.col("_k").alias(key),
        *(keep or {}),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"),
    )


def keep_good(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects.

    All columns are written beside the statistics, so each row meets its own verdict without a join and repeated
    rows, null keys and clashing names make no difference.
    """
    names = {f"_c{k}": c for k, c in enumerate(docs.columns)}
    judged = judge(docs, key=key, text=text, lang=lang, source=source, keep={n: quoted(c) for n, c in names.items()})
    return judged.where("kept").select(*[F.col(n).alias(c) for n, c in names.items()])
