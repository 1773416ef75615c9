"""Exact ranks, prefix sums, shuffles and samples without a window over all rows.

Rows are parted into buckets whose order is known beforehand; bucket totals are few, so their running sums are
cheap; then each bucket is ranked by itself. Buckets are prefixes of a hexadecimal place, as long as the rows
at hand need them, or ranges of a sort order that Spark samples. Either way a bucket holds some BUCKET_ROWS rows, or the
share of a partition, however the values are spread; only rows of one place can't be parted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sides import FEW, few
from corpusloom.sources.scratch import stored

BUCKET_ROWS = 100_000
"""Rows that one window may hold; a prefix of twice as many is split."""

_STEP = 4
"""Hexadecimal digits by which a prefix is refined: 65,536 parts at most."""


def hashed(seed: int | str, row_id: Column) -> Column:
    """A row's place in a seeded random order: the MD5 of seed:id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _same(names: list[str]) -> Column:
    """Rows whose columns of these names equal __k0, __k1, ..., nulls too."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)], F.lit(True))


def _renamed(names: list[str]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(names)]


def prefix_buckets(rows: DataFrame, keys: list[str], place: str, sums: list[str], limit: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows with __b, a prefix of their place, and per keys and __b the number of rows (__n) and the sums of some columns.

    A count per key tells how many digits are wanted. Prefixes that hold more than twice the limit are split by further
    digits, and only their rows are counted again, so a crowded prefix costs a pass over its own rows and no other
    bucket. Prefixes of several lengths never begin with each other, so they sort as their rows do. One bucket for all
    (no totals: None) where no key has more rows than the limit.
    """
    most = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.length(place)).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
    if (most.n or 0) <= limit or not most.width:
        return rows.withColumn("__b", F.lit("")), None
    digits, n, wide, open_rows, settled, bucket = 0, most.n, rows, rows, [], []
    while True:
        digits = min(most.width, digits + max(_STEP if digits else 1, math.ceil(math.log(n / limit, 16))))
        prefix = F.substring(place, 1, digits)
        each = stored(open_rows.groupBy(*keys, prefix.alias("__b")).agg(F.count("*").alias("__n"), *(F.sum(s).alias(s) for s in sums)), "buckets")
        crowded = F.col("__n") > (2 * limit if digits < most.width else math.inf)
        settled.append(each.where(~crowded))
        full = each.where(crowded).agg(F.count("*").alias("n"), F.max("__n").alias("most")).first()
        if not full.n:
            bucket.append(prefix)
            return wide.withColumn("__b", F.coalesce(*bucket)).select(*rows.columns, "__b"), reduce(DataFrame.unionByName, settled)
        n, mark = full.most, f"__full{digits}"
        marks = each.where(crowded).select(*_renamed([*keys, "__b"]))
        side = F.broadcast(marks) if full.n <= FEW else marks
        wide = wide.join(side, _same(keys) & (prefix == F.col(f"__k{len(keys)}")), "left").withColumn(mark, F.col(f"__k{len(keys)}").isNotNull()).drop(*(f"__k{i}" for i in range(len(keys) + 1)))
        bucket.append(F.when(~F.col(mark), prefix))
        open_rows = wide.where(mark)


def bucketed_prefix_sums(df: DataFrame, keys: list[str], place: Column, order: list[Column], values: dict[str, Column], limit: int = BUCKET_ROWS) -> DataFrame:
    """The running sums of values, by the names of new columns, within keys and in an order that begins with place, a hexadecimal string."""
    each = {f"__v{i}": v for i, v in enumerate(values.values())}
    rows, totals = prefix_buckets(df.withColumn("__p", place).withColumns(each), keys, "__p", list(each), limit)
    if totals is None:
        inside = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # limit rows
        return rows.withColumns({out: F.sum(f"__v{i}").over(inside) for i, out in enumerate(values)}).drop("__b", "__p", *each)
    return _with_offsets(rows, keys, "__b", totals, order, list(values)).drop("__b", "__p", *each)


def _with_offsets(rows: DataFrame, keys: list[str], bucket: str, totals: DataFrame, order: list[Column], outs: list[str]) -> DataFrame:
    """Sums inside buckets, on top of the totals of the key's buckets before."""
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = totals.select(*_renamed([*keys, bucket]), *(F.coalesce(F.sum(f"__v{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(outs))))
    joined = rows.join(few(offsets), _same([*keys, bucket])).select(*rows.columns, *(f"__o{i}" for i in range(len(outs))))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {out: F.col(f"__o{i}") + F.sum(f"__v{i}").over(inside) for i, out in enumerate(outs)}
    return joined.withColumns(sums).drop(*(f"__o{i}" for i in range(len(outs))))


def ranged_prefix_sums(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """The running sums of values, by the names of new columns, within keys and in an order, over sampled ranges of both.

    Spark's range partitioning cuts keys and order into partitions of like size, so neither a large key nor crowded values make a
    large one, nor do small keys make many. The partition is stored with the row, as another sampling might cut elsewhere; its sums
    (a row per partition and key in it) give the offsets. order must tell apart rows whose sums shall differ in a defined way.
    """
    each = {f"__v{i}": v for i, v in enumerate(values.values())}
    ranged = df.withColumns(each).repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id())
    rows = stored(ranged, "ranges")
    totals = rows.groupBy(*keys, "__part").agg(*(F.sum(v).alias(v) for v in each))
    return _with_offsets(rows, keys, "__part", totals, order, list(values)).drop("__part", *each)


def bucketed_rank(df: DataFrame, keys: list[str], place: Column, tie: str, out: str, limit: int = BUCKET_ROWS) -> DataFrame:
    """The rank (from 1) of a hexadecimal string, such as a hash, within keys, ties by another column."""
    ranked = bucketed_prefix_sums(df.withColumn("__h", place), keys, F.col("__h"), [F.col("__h"), F.col(tie)], {out: F.lit(1).cast("long")}, limit)
    return ranked.drop("__h")


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int, out: str = "position") -> DataFrame:
    """E5: each row's position (from 1) in the random order of an epoch."""
    return bucketed_rank(df, [], F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(id_col).cast("string"))), id_col, out)


def place_of_nth(rows: DataFrame, place: str, n: int, limit: int = BUCKET_ROWS) -> str | None:
    """A prefix of the n-th smallest place such that limit rows at most begin with it, unless these have one place; None if there are no more than n rows.

    Rows are only counted: 65,536 prefixes at a time, of those rows that begin with the last one.
    """
    within, before, digits = "", 0, 0
    while True:
        digits += _STEP
        counts = rows.where(F.col(place).startswith(within)).groupBy(F.substring(place, 1, digits).alias("p")).agg(F.count("*").alias("n"), F.max(F.length(place)).alias("width"))
        running = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p"))  # 65,536 rows at most
        hit = counts.withColumn("upto", running).where(F.col("upto") >= n - before).orderBy("p").first()
        if hit is None or (not before and hit.upto == n and counts.where(F.col("p") > hit.p).isEmpty()):
            return None
        if hit.n <= limit or digits >= hit.width:
            return hit.p
        within, before = hit.p, before + hit.upto - hit.n


def sample_n(df: DataFrame, id_col: str, n: int, seed: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """exactly n rows at random, or all if there are no more: those of the n smallest hashes. Only they, and the rest of the n-th one's bucket, are shuffled and ranked."""
    rows = df.withColumn("__place", hashed(seed, F.col(id_col)))
    last = place_of_nth(rows, "__place", n, limit) if n > 0 else ""
    if last is None:
        return df
    near = rows.where(F.substring("__place", 1, len(last)) <= last)
    return bucketed_rank(near, [], F.col("__place"), id_col, "__rank", limit).where(F.col("__rank") <= n).drop("__rank", "__place")


def cumulative_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score, descending: n, pos, and the running tp and seen. scores: keys, label, score.

    Scores are collapsed before they are summed up, so ties cannot matter; distinct scores are summed up by ranges.
    """
    each = scores.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    return ranged_prefix_sums(each, keys, [F.col("score").desc()], {"tp": F.col("pos"), "seen": F.col("n")})
