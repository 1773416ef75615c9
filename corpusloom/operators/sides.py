"""Small sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 10_000
"""Rows up to which a side is broadcast."""


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A side with a row per class, run or the like, read now and broadcast if it has `most` rows at most; else as it is.

    Left to itself, the planner takes such a side for as large as what it was aggregated from, and sorts both.
    """
    rows = df.take(most + 1)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df
