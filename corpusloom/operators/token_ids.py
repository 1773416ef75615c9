"""Token ids by a vocabulary of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tfidf import BROADCAST_TERMS

PAD, UNKNOWN, FIRST = 0, 1, 2
"""The ids of padding, of words outside the vocabulary, and of its first word."""


def word_ids(df: DataFrame, tokens_col: str, size: int = 50_000) -> DataFrame:
    """term and id of the `size` most frequent words, most frequent first; ties by word. Nulls don't count."""
    # Outer, with the filter above them: one below would make all tokens twice more.
    each = df.select(F.explode_outer(tokens_col).alias("term")).where("term IS NOT NULL")
    counts = each.groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    by_count = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "term")  # `size` rows
    return top.select("term", (F.row_number().over(by_count) + (FIRST - 1)).cast("int").alias("id"))


def encode_tokens(df: DataFrame, id_col: str, tokens_col: str, words: DataFrame, limit: int | None = None, size: int = 50_000) -> DataFrame:
    """row_id and ids, the words' ids in order, UNKNOWN for what the vocabulary lacks, of the first `limit` words if given.

    Rows are dealt by row_id before their words are taken apart, and the vocabulary (`size` rows at most) is broadcast up to
    BROADCAST_TERMS of them, so no pair of row and word is shuffled. row_id must be unique. Rows without words: no ids; null words: UNKNOWN.
    """
    kept = F.col(tokens_col) if limit is None else F.slice(tokens_col, 1, limit)
    rows = df.select(F.col(id_col).alias("row_id"), kept.alias("__t")).repartition("row_id")
    each = rows.select("row_id", F.posexplode_outer("__t").alias("__pos", "term"))
    side = words.select("term", F.col("id").alias("__id"))
    known = each.join(F.broadcast(side) if size <= BROADCAST_TERMS else side, "term", "left")
    place = F.when(F.col("__pos").isNotNull(), F.struct("__pos", F.coalesce("__id", F.lit(UNKNOWN)).alias("id")))
    return known.groupBy("row_id").agg(F.sort_array(F.collect_list(place))["id"].alias("ids"))
