"""Column names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All columns of ``names`` under their new names, all at once."""
    return df.select(*[quoted(old).alias(new) for old, new in names.items()])
