"""Volume estimates and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters in a token, and tokens that training needs.
CHARS_PER_TOKEN, TOKEN_TARGET = 3.7, 3_000_000_000


def estimate_tokens(df: DataFrame, content: str, by: list[str] | None = None) -> DataFrame:
    """Documents, characters, characters a document, and estimated tokens (also in billions), over all rows."""
    n, chars = F.count("*"), F.coalesce(F.sum(F.length(content)), F.lit(0)).cast("long")
    sums = df.groupBy(*(by or [])).agg(n.alias("documents"), chars.alias("total_chars"))
    tokens = (F.col("total_chars") / F.lit(CHARS_PER_TOKEN)).cast("long")
    return sums.select(
        *(by or []),
        "documents",
        "total_chars",
        (F.col("total_chars") / F.greatest(F.lit(1), F.col("documents"))).alias("avg_chars_per_doc"),
        tokens.alias("estimated_tokens"),
        (tokens / 1e9).alias("estimated_tokens_b"),
        F.lit("tokens").alias("unit"),
    )


def token_sufficiency(tokens: DataFrame, ids: str, target: int = TOKEN_TARGET) -> DataFrame:
    """Total of an id-list column against the target; no row for an empty table."""
    total = tokens.agg(F.sum(F.size(ids)).alias("total_tokens")).where("total_tokens is not null")
    share = F.col("total_tokens") / F.lit(target)
    return total.select(
        "total_tokens",
        F.lit(target).cast("long").alias("target_tokens"),
        F.when(F.col("total_tokens") >= target, F.lit("SUFFICIENT"))
        .otherwise(F.concat(F.lit("INSUFFICIENT ("), F.format_string("%.1f", share * 100), F.lit("%)")))
        .alias("status"),
    )


def pass_rate(valid: Column | str) -> Column:
    """Share of valid rows; null without rows."""
    c = F.col(valid) if isinstance(valid, str) else valid
    return F.avg(c.cast("int"))


def perplexity(df: DataFrame, loss: str, weight: str) -> DataFrame:
    """Weighted mean loss, and its exponential with the loss capped at 20."""
    mean = F.coalesce(F.sum(F.col(loss) * F.col(weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(1))
    return df.agg(mean.alias("loss")).withColumn("perplexity", F.exp(F.least("loss", F.lit(20.0))))


def accuracy(predicted: str, truth: str) -> Column:
    """Share of equal pairs; 0 without rows."""
    return F.coalesce(F.avg((F.col(predicted) == F.col(truth)).cast("int")), F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's r in two steps, 0 where a column hardly varies, so constant columns divide by nothing."""
    keys = by or []
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = kept.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    both = kept.join(means, keys) if keys else kept.crossJoin(F.broadcast(means))  # the right side is one row
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = both.groupBy(*keys).agg(F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"))
    size = F.sqrt("_xx") * F.sqrt("_yy")
    return sums.select(*keys, F.when(F.coalesce(size, F.lit(0.0)) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.col("_xy"), size)).alias("pearson_r"))


def count_parameters(layers: int, dim: int, vocab: int, hidden: int, heads: int, kv_heads: int | None = None, tied: bool = True) -> int:
    """Weights of a decoder with gated feed-forward layers, in closed form."""
    kv = dim * (kv_heads or heads) // heads
    block = 2 * dim * dim + 2 * dim * kv + 3 * dim * hidden + 2 * dim
    return vocab * dim * (1 if tied else 2) + layers * block + dim


def feed_forward_width(dim: int) -> int:
    """Two thirds of four times ``dim``, rounded up to 256."""
    return -(-(8 * dim // 3) // 256) * 256


#: Tokens a parameter beyond which a run trains for longer than the compute-optimal ratio asks for.
OVERTRAINING = 30.0


def token_budget(parameters: int, ratio: float, batch: int, accumulate: int, length: int, steps: int | None = None) -> dict[str, object]:
    """Tokens that a model of so many parameters should see, tokens a step, and the steps that takes (unless given)."""
    per_step, budget = batch * accumulate * length, int(parameters * ratio)
    needed = max(1, -(-budget // max(1, per_step)))
    regime = "overtraining" if ratio > OVERTRAINING else "chinchilla-optimal"
    return {"tokens_per_step": per_step, "target_tokens": budget, "steps": needed if steps is None else steps, "regime": regime}
