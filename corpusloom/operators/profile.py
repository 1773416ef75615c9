"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import approx_token_len, label_name
from corpusloom.operators.sides import few

THRESHOLDS = (512, 1024, 2048, 4096, 8192)


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """Label, name, n, percent of all rows and the imbalance (rows of label 0 per row of label 1), by label."""
    label = F.col(label_col)
    each = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("n1"))
    joined = each.crossJoin(F.broadcast(total))  # one row
    return joined.select("label", label_name(F.col("label")).alias("name"), "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), (F.col("n0") / F.greatest("n1", F.lit(1))).alias("imbalance")).orderBy("label")


def corpus_summary(df: DataFrame, label_col: str) -> DataFrame:
    """One row: total, rows and percent of both classes, imbalance."""
    n0, n1 = F.count_if(F.col(label_col) == 0), F.count_if(F.col(label_col) == 1)
    sums = df.agg(F.count("*").alias("total"), n0.alias("n_secure"), n1.alias("n_vulnerable"))
    share = lambda c: F.col(c) * 100.0 / F.greatest("total", F.lit(1))
    return sums.select("*", share("n_secure").alias("pct_secure"), share("n_vulnerable").alias("pct_vulnerable"), (F.col("n_secure") / F.greatest("n_vulnerable", F.lit(1))).alias("imbalance"))


def ordered_value_counts(df: DataFrame, value_col: str) -> DataFrame:
    """value and n, by value."""
    return df.groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def quantiles_of_counts(each: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """Per keys: n, mean_len, max_len and p, the exact quantiles by linear interpolation, from the number of rows (n) of each len.

    Rows are counted by value first, so a window holds the distinct lengths of a key, which the longest text bounds, not its rows.
    """
    key = Window.partitionBy(*keys or [F.lit(0)])
    upto = F.sum("n").over(key.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    rows = each.where("len is not null").withColumns({"__upto": upto, "__total": F.sum("n").over(key)})
    place = lambda q: (F.col("__total") - 1) * F.lit(float(q))
    value = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("len")))
    parts = [c for i, q in enumerate(at) for c in (value(F.floor(place(q))).alias(f"__lo{i}"), value(F.ceil(place(q))).alias(f"__hi{i}"), F.max(place(q) - F.floor(place(q))).alias(f"__at{i}"))]
    stats = rows.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"), F.max("len").cast("long").alias("max_len"), *parts)
    p = F.array(*(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__at{i}") for i in range(len(at))))
    return stats.select(*keys, "n", "mean_len", "max_len", p.alias("p"))


def length_stats(df: DataFrame, label_col: str, text_col: str, tokens: Column | None = None, exact: bool = True) -> DataFrame:
    """Mean, median, p95, p99 and max length per class and overall (label null), and int(p95) as suggested limit.

    tokens: the length of a row, a quarter of the characters by default. exact=False: approximate percentiles.
    """
    n = tokens if tokens is not None else approx_token_len(F.col(text_col))
    quantiles = (0.5, 0.95, 0.99)
    rows = df.select(F.col(label_col).alias("label"), n.alias("len"))
    if exact:
        each = rows.groupBy("label", "len").agg(F.count("*").alias("n")).withColumn("is_all", F.lit(0))
        whole = each.groupBy("len").agg(F.sum("n").alias("n")).select(F.lit(None).cast(each.schema["label"].dataType).alias("label"), "len", "n", F.lit(1).alias("is_all"))
        stats = quantiles_of_counts(each.unionByName(whole), ["label", "is_all"], quantiles)
    else:
        cut = F.percentile_approx("len", F.array(*map(F.lit, quantiles)), 10000)
        stats = rows.groupingSets([["label"], []], "label").agg(F.avg("len").alias("mean_len"), cut.alias("p"), F.max("len").cast("long").alias("max_len"), F.grouping("label").alias("is_all"))
    p = lambda i: F.col("p")[i].cast("double")
    return stats.select("label", F.col("is_all").cast("int").alias("is_all"), "mean_len", p(0).alias("median_len"), p(1).alias("p95_len"), p(2).alias("p99_len"), "max_len", F.floor(p(1)).cast("long").alias("suggested_len"))


def truncation_rate(df: DataFrame, tokens: Column, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Threshold and percent of rows longer than it."""
    rates = df.select(tokens.alias("len")).agg(*(F.avg((F.col("len") > t).cast("int")).alias(f"t{t}") for t in thresholds))
    rows = [F.struct(F.lit(t).alias("threshold"), (F.col(f"t{t}") * 100).alias("pct_truncated")) for t in thresholds]
    return rates.select(F.inline(F.array(*rows)))


def clipped_length_stats(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """Mean, median, p95 and max of the lengths cut to a limit, and percent of rows over it."""
    each = df.groupBy(F.least(tokens, F.lit(limit)).alias("len")).agg(F.count("*").alias("n"), F.count_if(tokens > limit).alias("cut"))
    stats = quantiles_of_counts(each, [], (0.5, 0.95))
    cut = each.agg((F.sum("cut") * 100 / F.sum("n")).alias("pct_truncated"))  # a row each
    return stats.crossJoin(F.broadcast(cut)).select("n", "mean_len", F.col("p")[0].alias("median_len"), F.col("p")[1].alias("p95_len"), "max_len", "pct_truncated")


def length_histogram(df: DataFrame, label_col: str, tokens: Column, bins: int = 80) -> DataFrame:
    """Label, bin (from 0) and n, in bins of equal width per class; the last one is closed."""
    rows = df.select(F.col(label_col).alias("label"), tokens.alias("len"))
    span = rows.groupBy(F.col("label").alias("of")).agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    wide = rows.join(few(span), F.col("label").eqNullSafe(F.col("of")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("len") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return wide.groupBy("label", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_frequency(df: DataFrame, label_col: str, tags: Column) -> DataFrame:
    """Among rows with label 1: each category's n and percent of all categories, how many categories and labels there are."""
    each = df.where(F.col(label_col) == 1).select(F.explode(tags).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("n_labels"), F.count("*").alias("n_categories"))
    return each.crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") * 100.0 / F.col("n_labels")).alias("percent"), "n_categories", "n_labels")


def top_categories(df: DataFrame, label_col: str, tags: Column, n: int = 15) -> DataFrame:
    """the n most frequent categories among rows with label 1; ties by name."""
    each = df.where(F.col(label_col) == 1).select(F.explode(tags).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "category").limit(n)


def category_by_class(df: DataFrame, label_col: str, tags: Column, text: Column | None = None, n: int = 15, mode: str = "exact") -> DataFrame:
    """Rows of each class per top category, most frequent first.

    mode exact: a row counts for the categories it lists; substring: for those its text of categories contains.
    """
    top = F.broadcast(top_categories(df, label_col, tags, n).select("category", F.col("n").alias("rank_n")))  # n rows
    if mode == "exact":
        rows = df.select(F.col(label_col).alias("label"), F.explode(F.array_distinct(tags)).alias("category")).join(top, "category")
    elif mode == "substring":
        rows = df.select(F.col(label_col).alias("label"), text.alias("__text")).join(top, F.contains("__text", "category"))
    else:
        raise ValueError(f"mode must be exact or substring, not {mode!r}")
    wide = rows.groupBy("category", "rank_n").agg(F.count_if(F.col("label") == 0).alias("n_secure"), F.count_if(F.col("label") == 1).alias("n_vulnerable"))
    return wide.orderBy(F.desc("rank_n"), "category").select("category", "n_secure", "n_vulnerable")


def primary_categories(df: DataFrame, label_col: str, tags: Column, tracked: list[str]) -> DataFrame:
    """Rows with label 1 of each tracked category, 0 for those that have none."""
    each = df.where(F.col(label_col) == 1).select(F.explode(tags).alias("category")).where(F.col("category").isin(tracked)).groupBy("category").agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(t,) for t in tracked], "category string")
    return wanted.join(each, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
