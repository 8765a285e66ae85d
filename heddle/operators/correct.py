"""Generation that is checked and asked for again: rounds over a table of prompts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import parsers, prompts, verify
from heddle.sources.shared import materialise


def self_correct(
    tasks: DataFrame,
    prompt: str,
    generate: Callable[[DataFrame, str, str], DataFrame],
    language: str,
    *,
    check: Callable[[str], Column] | None = None,
    rounds: int = 2,
    system: str = "",
) -> DataFrame:
    """``tasks`` with code, verified, heuristic, attempts, error, checker and raw_response (the reply that passed).

    ``generate`` adds a column of replies to a column of formatted prompts (its second and third argument are their
    names; :func:`heddle.sources.teacher.replies` is one), ``check`` gives the result struct of a code column. Each round
    asks for all tasks that are still open at once; those that fail are asked again with the error, those that pass are
    done. A round is written before it is used, so no reply is asked for twice. Tasks that fail the last round keep its
    code and error and count as neither verified nor heuristic.
    """
    names = tasks.columns
    verdict = check or (lambda code: verify.verify_code(code, F.lit(language)))
    still, done = tasks.withColumn("_now", F.col(prompt)), []
    for attempt in range(1, rounds + 1):
        asked = still.withColumn("_full", prompts.agent_prompt(F.lit(system), "_now"))
        answered = generate(asked, "_full", "_reply").withColumn("code", parsers.extract_code("_reply"))
        judged = materialise(answered.withColumn("_r", verdict("code")).drop("_full"), "self-correct")
        over = F.col("_r.valid") | F.lit(attempt == rounds)
        passed = F.col("_r.valid")
        done.append(
            judged.where(over).select(
                *names,
                "code",
                (passed & F.col("_r.verified")).alias("verified"),
                (passed & F.col("_r.heuristic")).alias("heuristic"),
                F.lit(attempt).alias("attempts"),
                F.when(~passed, F.coalesce("_r.error", F.lit("Unknown error."))).alias("error"),
                F.col("_r.checker").alias("checker"),
                F.when(passed, F.col("_reply")).alias("raw_response"),
            )
        )
        again = prompts.correction_prompt(prompt, F.coalesce("_r.error", F.lit("Unknown error.")), F.lit(language))
        still = judged.where(~over).select(*names, again.alias("_now"))
    return reduce(DataFrame.unionByName, done)
