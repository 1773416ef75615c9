"""Tables that cut lineage, in the folder that all executors share, and a column function."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import folder, forget, new_path, stored

__all__ = ["Steps", "ascii_lower", "folder", "forget", "new_path", "stored"]


class Steps:
    """The tables stored on the way to a result; they go together, once the result is stored itself or has failed."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        forget(*self.tables)
        self.tables.clear()


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case, and no other letter."""
    ascii_only = F.octet_length(text) == F.length(text)  # there the faster function gives the same
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
