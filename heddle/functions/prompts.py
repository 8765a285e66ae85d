"""Prompt routing, chat and correction templates, token tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import col, contains_any, is_blank, occurrences, strip

# Substrings of demanding prompts, and the characters that are punctuation when alone.
COMPLEX_MARKS = (
    "refactor", "design", "architecture", "plan", "optimize", "optimization", "debug", "security", "vulnerability", "audit",
    "migrate", "migration", "algorithm", "concurrency", "distributed", "microservice", "explain why", "trade-off", "tradeoff",
    "benchmark", "complex", "performance", "<think>",
)
PUNCTUATION = ",.;:()[]{}<>=+-*/\\\"'`~|&!%^@#$?"
LONG_PROMPT, MANY_BREAKS = 250, 4


def is_complex_prompt(prompt: Column | str) -> Column:
    """Whether a prompt has a demanding word, over 250 characters or 4 line breaks."""
    p = F.coalesce(col(prompt), F.lit(""))
    return contains_any(F.lower(p), COMPLEX_MARKS) | (F.length(strip(p)) > LONG_PROMPT) | (occurrences(p, "\n") >= MANY_BREAKS)


def classify_prompt(prompt: Column | str, small: int = 512, large: int = 1024) -> Column:
    """Width of the model slice for a prompt."""
    return F.when(is_complex_prompt(prompt), F.lit(large)).otherwise(F.lit(small))


def resolve_active_dim(prompt: Column | str, slices: list[int], mode: str | int = "auto") -> Column:
    """The routed slice (smallest or largest) in automatic mode, else the one given."""
    if mode == "auto":
        return classify_prompt(prompt, min(slices), max(slices))
    return F.lit(int(mode))


def is_factual_token(token: Column | str) -> Column:
    """Not blank and not a lone punctuation mark."""
    t = strip(F.coalesce(col(token), F.lit("")))
    lone = (F.length(t) == 1) & (F.instr(F.lit(PUNCTUATION), t) > 0)
    return ~is_blank(t) & ~lone


def mark_uncertain(token: Column | str, entropy: Column | str, threshold: float, tag: str = "<uncertain>") -> Column:
    """``token`` after the tag where its entropy exceeds the threshold and it may be a claim."""
    return F.when((col(entropy) > threshold) & is_factual_token(token), F.concat(F.lit(tag), col(token))).otherwise(col(token))


def wrap_chat(role: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("<|im_start|>"), col(role), F.lit("\n"), col(content), F.lit("<|im_end|>"))


def agent_prompt(system: Column | str, user: Column | str, think: bool = True) -> Column:
    """System and user turns, and the opening of the assistant's."""
    opening = F.lit("<|im_start|>assistant\n" + ("<think>\n" if think else ""))
    return F.concat(wrap_chat(F.lit("system"), system), F.lit("\n"), wrap_chat(F.lit("user"), user), F.lit("\n"), opening)


def wrap_thinking(reasoning: Column | str, answer: Column | str) -> Column:
    return F.concat(F.lit("<think>\n"), col(reasoning), F.lit("\n</think>\n"), col(answer))


def wrap_tool_call(call: Column | str, response: Column | str) -> Column:
    return F.concat(
        F.lit("<tool_call>\n"), col(call), F.lit("\n</tool_call>\n<tool_response>\n"), col(response), F.lit("\n</tool_response>")
    )


def correction_prompt(original: Column | str, error: Column | str, language: Column | str) -> Column:
    """A turn that feeds a checker's error back."""
    return F.concat(
        F.lit("The previous "), col(language), F.lit(" code produced the following error:\n```\n"), col(error),
        F.lit("\n```\nOriginal task: "), col(original), F.lit("\nPlease fix all errors and provide the complete, working "),
        col(language), F.lit(" solution inside <code> tags."),
    )


def fill_template(template: str, **values: Column | str) -> Column:
    """``{name}`` in ``template`` replaced by columns; ``{{`` and ``}}`` are braces."""
    parts: list[Column] = []
    from string import Formatter

    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(col(values[name]).cast("string"))
    return F.concat(*parts)
