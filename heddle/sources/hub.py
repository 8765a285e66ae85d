"""Projections of public code corpora onto the document schema. Fetching them is left to the caller: no network here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import is_blank
from heddle.operators.filtering import limit_per_group

# Fixed value: folder names of languages in such corpora.
FOLDERS = {
    "javascript": "JavaScript", "typescript": "TypeScript", "python": "Python", "vue": "Vue", "css": "CSS",
    "html": "HTML", "markdown": "Markdown", "json": "JSON", "yaml": "YAML",
}


def folder_of(language: str) -> str:
    """Folder of a language; the language itself where none is known."""
    return FOLDERS.get(language, language)


def project_documents(df: DataFrame, per_language: int = 500_000, order: list[str] | None = None) -> DataFrame:
    """The five document columns, at most ``per_language`` rows a language."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("content", "lang", "license", "repo", "path")]
    return limit_per_group(df.select(*columns), "lang", per_language, order or ["path"])


def project_starred(df: DataFrame, license: str = "permissive", per_language: int = 300_000, keep_path: bool = False) -> DataFrame:
    """Rows of a corpus without licenses; blank ones are dropped before the limit counts.

    The constant license is on no allow-list and the path keeps its long name, so the filter drops such rows
    and scores no path; pass a listed license and ``keep_path`` to use them.
    """
    kept = df.where(~is_blank("content"))
    path = "path" if keep_path else "max_stars_repo_path"
    out = kept.select(
        "content", "lang", F.lit(license).alias("license"), "max_stars_repo_name", F.col("max_stars_repo_path").alias(path)
    )
    return limit_per_group(out, "lang", per_language, [path])
