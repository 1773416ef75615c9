"""Padded token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import truncate_pad_mask
from corpusloom.operators.rank import bucketed_rank, hashed
from corpusloom.sources.scratch import stored

BUCKET_IDS = 4 << 20
"""Token ids that one window may hold at most, as rows are ranked together with their ids."""


def assemble_batches(df: DataFrame, id_col: str, ids_col: str, batch_size: int = 8, limit: int = 4096, pad: int = 0, side: str = "right", seed: int | None = None, by_length: bool = False) -> DataFrame:
    """batch_id, row_id, input_ids and attention_mask, padded to the longest row of the batch; the last batch may be short.

    Order: by a seeded hash; with by_length rows of like length come together, to pad less; without a seed by the hash of seed 0.
    """
    # Stored, as ranks and lengths read the rows several times, and ids may be costly to make.
    rows = stored(df.select(F.col(id_col).alias("row_id"), F.slice(ids_col, 1, limit).alias("ids")), "ids")
    place = hashed(seed or 0, F.col("row_id"))
    if by_length:
        # Longest first: the length, as hexadecimal digits counted down, before the hash, which parts rows of one length.
        place = F.concat(F.lpad(F.hex(F.lit(limit) - F.size("ids")), len(f"{limit:x}"), "0"), place)
    ranked = bucketed_rank(rows, [], place, "row_id", "rank", max(batch_size, BUCKET_IDS // limit))
    numbered = ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size).cast("long"))
    longest = numbered.groupBy("batch_id").agg(F.max(F.size("ids")).alias("to"))
    padded, mask = truncate_pad_mask(F.col("ids"), limit, F.col("to"), pad, side)
    return numbered.join(longest, "batch_id").select("batch_id", "row_id", padded.alias("input_ids"), mask.alias("attention_mask"))


def padding_waste(batches: DataFrame) -> DataFrame:
    """n_batches, n_rows and the part of all places that is padding."""
    each = batches.select("batch_id", F.size("input_ids").alias("to"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("len"))
    return each.agg(F.countDistinct("batch_id").alias("n_batches"), F.count("*").alias("n_rows"), (F.sum(F.col("to") - F.col("len")) / F.sum("to")).alias("waste"))
