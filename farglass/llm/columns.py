"""Names for the columns that operators add, such that none of the user's is touched."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_prefix(columns: Iterable[str], prefix: str) -> str:
    """``prefix``, with as many further underscores as it takes until no column begins with it.

    Operators that add columns name them with it. So a user's column ``license_found`` keeps its
    values, and the column added is ``license__found``.
    """
    names = [c.lower() for c in columns]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def own(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(df: DataFrame) -> list[Column]:
    return [own(c) for c in df.columns]
