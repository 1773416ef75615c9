"""Deterministic stratified splits and folds, and what reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.rank import bucketed_rank, hashed
from corpusloom.operators.sides import few


def stratified_holdout(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """row_id, label and split (train or holdout).

    The holdout has ceil(test_size * n) rows; each class its proportional part, rounded down, and
    one row more for the classes of the largest remainders (ties: the lower label). Inside a class, the rows
    that come first by a seeded hash are held out, whatever the order or partitioning of the rows.
    """
    rows = df.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label"))
    all_classes = Window.partitionBy(F.lit(0))  # one row per class
    n = F.sum("n_c").over(all_classes)
    parts = rows.groupBy("label").agg(F.count("*").alias("n_c")).withColumn("n_test", F.ceil(n * F.lit(float(test_size)))).withColumn("part", F.col("n_c") * F.col("n_test") / n)
    based = parts.withColumn("base", F.floor("part")).withColumn("left", F.col("n_test") - F.sum(F.floor("part")).over(all_classes))
    first = F.row_number().over(all_classes.orderBy(F.desc(F.col("part") - F.col("base")), "label")) <= F.col("left")
    quota = few(based.select(F.col("label").alias("__l"), (F.col("base") + first.cast("long")).alias("q")))
    ranked = bucketed_rank(rows, ["label"], hashed(seed, F.col("row_id")), "row_id", "rank")
    joined = ranked.join(quota, F.col("label").eqNullSafe(F.col("__l")))
    return joined.select("row_id", "label", F.when(F.col("rank") <= F.col("q"), F.lit("holdout")).otherwise(F.lit("train")).alias("split"))


def check_size(df: DataFrame, least: int = 10) -> DataFrame:
    """E1's guard: the DataFrame itself; an error if it has fewer rows than `least`."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"a split needs {least} rows at least; there are {n}")
    return df


def stratified_kfold(split: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """row_id, label and fold (0 to k - 1) of the train rows; per class, fold sizes differ by 1 at most."""
    train = split.where("split = 'train'").select("row_id", "label")
    each = train.groupBy("label").agg(F.count("*").alias("n_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    offsets = each.select(F.col("label").alias("__l"), F.coalesce(F.sum("n_c").over(before), F.lit(0)).alias("offset"))
    ranked = bucketed_rank(train, ["label"], hashed(f"fold:{seed}", F.col("row_id")), "row_id", "rank")
    joined = ranked.join(few(offsets), F.col("label").eqNullSafe(F.col("__l")))
    return joined.select("row_id", "label", ((F.col("offset") + F.col("rank") - 1) % k).cast("int").alias("fold"))


def split_meta(split: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """A10: one row: settings, sizes and rates of label 1."""
    held = F.col("split") == "holdout"
    return split.agg(
        F.lit(float(test_size)).alias("test_size"),
        F.lit(seed).alias("random_state"),
        F.count("*").alias("n_total"),
        F.count_if(~held).alias("n_train"),
        F.count_if(held).alias("n_holdout"),
        F.avg(F.when(~held, F.col("label"))).alias("train_pos_rate"),
        F.avg(F.when(held, F.col("label"))).alias("holdout_pos_rate"),
    )


def positive_rates(split: DataFrame, folds: DataFrame) -> DataFrame:
    """D3: part, fold, n and pos_rate: both splits (fold -1), and train and val of each fold.

    The train side of a fold is all train rows less the fold, so folds are counted once.
    """
    sides = split.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).withColumn("fold", F.lit(-1))
    each = folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    total = each.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    both = each.crossJoin(F.broadcast(total))
    val = both.select(F.lit("val").alias("part"), "n", "pos", "fold")
    train = both.select(F.lit("cv_train").alias("part"), (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_pos") - F.col("pos")).alias("pos"), "fold")
    rows = sides.unionByName(val).unionByName(train)
    return rows.select("part", "fold", "n", (F.col("pos") / F.col("n")).alias("pos_rate"))


def gather_by_split(df: DataFrame, split: DataFrame, id_col: str, side: str) -> DataFrame:
    """The rows of one side of a split, with all their columns."""
    keys = split.where(F.col("split") == side).select(F.col("row_id").alias(id_col))
    return df.join(keys, id_col, "left_semi")


def texts_and_labels(df: DataFrame, split: DataFrame, id_col: str, text_col: str, label_col: str, side: str = "train") -> DataFrame:
    """Text and whole-number label of one side of a split."""
    return gather_by_split(df, split, id_col, side).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))


def attach_fold(df: DataFrame, split: DataFrame, folds: DataFrame, id_col: str) -> DataFrame:
    """All rows with their split, and their fold (null on the holdout)."""
    sides = split.select(F.col("row_id").alias(id_col), "split")
    of = folds.select(F.col("row_id").alias(id_col), "fold")
    return df.join(sides, id_col).join(of, id_col, "left")


def cv_subset(attached: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows of a fold."""
    train = attached.where("split = 'train'")
    return train.where(F.col("fold") != fold), train.where(F.col("fold") == fold)


def complement(df: DataFrame, holdout: DataFrame, id_col: str) -> DataFrame:
    """The rows that are not held out."""
    return df.join(holdout.select(F.col("row_id").alias(id_col)), id_col, "left_anti")


def disjointness(df: DataFrame, split: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """n_both (ids on both sides), n_missing (rows on none) and n_shared_texts (texts on both)."""
    sides = df.select(F.col(id_col).alias("row_id"), F.md5(text_col).alias("text_key")).join(split.select("row_id", "split"), "row_id", "left")
    by_id = sides.groupBy("row_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    ids = by_id.agg(F.count_if(F.col("a") != F.col("b")).alias("n_both"), F.count_if(F.col("a").isNull()).alias("n_missing"))
    by_text = sides.where("text_key is not null").groupBy("text_key").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return ids.crossJoin(by_text.agg(F.count_if(F.col("a") != F.col("b")).alias("n_shared_texts")))


def partition_invariants(split: DataFrame) -> DataFrame:
    """Rows in the intersection of both sides, and in their union."""
    train, held = (split.where(F.col("split") == s).select("row_id") for s in ("train", "holdout"))
    both = train.intersect(held).agg(F.count("*").alias("n_intersection"))
    return both.crossJoin(train.union(held).distinct().agg(F.count("*").alias("n_union")))
