"""Validation, cleaning and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names under which a category column may come, first one present wins.
CATEGORY_COLUMNS = ("cwe", "CWE", "cwe_id", "cwe_ids", "weakness", "vuln_type")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """B1: the DataFrame itself; an error that names the columns it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def resolve_column(df: DataFrame, to: str, names: tuple[str, ...] = CATEGORY_COLUMNS) -> DataFrame | None:
    """The DataFrame with the first of the named columns renamed; None if it has none of them."""
    found = next((n for n in names if n in df.columns), None)
    return df.withColumnRenamed(found, to) if found else None


def invalid_labels(df: DataFrame, label_col: str) -> DataFrame:
    """B2, G1: the distinct labels, nulls aside, that are neither 0 nor 1."""
    label = F.col(label_col)
    return df.where(label.isNotNull() & ~label.isin(0, 1)).select(label).distinct()


def validate_labels(df: DataFrame, label_col: str) -> DataFrame:
    """B2: the DataFrame itself; an error that lists labels other than 0 and 1."""
    bad = [r[0] for r in invalid_labels(df, label_col).limit(20).collect()]
    if bad:
        raise ValueError(f"labels must be 0 or 1; found {sorted(bad)}")
    return df


def drop_nulls(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """The rows that have a text and a label."""
    return df.dropna(subset=[text_col, label_col])


def schema_report(df: DataFrame) -> DataFrame:
    """column_name, data_type and n_nulls of each column, in one pass."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"`{c}`").alias("n_nulls")) for c, t in df.dtypes]
    return counts.select(F.inline(F.array(*rows)))


def first_row(df: DataFrame, id_col: str) -> DataFrame:
    """the row of the smallest id."""
    return df.orderBy(id_col).limit(1)


def positives_only(df: DataFrame, label_col: str) -> DataFrame:
    """The rows with label 1; the filter reaches the scan."""
    return df.where(F.col(label_col) == 1)


def _text_key(text_col: str) -> Column:
    return F.sha2(F.col(text_col), 256)


def dedup(df: DataFrame, text_col: str, label_col: str, id_col: str) -> DataFrame:
    """Of rows with equal text and label (nulls are equal) the one of the smallest id, with all its columns.

    Texts are shuffled once; keys as hashes, pre-aggregated.
    """
    best = df.groupBy(_text_key(text_col), F.col(label_col)).agg(F.min_by(F.struct(*df.columns), F.col(id_col)).alias("row"))
    return best.select("row.*")


def label_conflicts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """text_key and n_rows of the texts that have several labels."""
    found = df.groupBy(_text_key(text_col).alias("text_key")).agg(F.min(label_col).alias("__a"), F.max(label_col).alias("__b"), F.count("*").alias("n_rows"))
    return found.where("__a <> __b").select("text_key", "n_rows")


def null_loss(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """n_rows, n_after_dedup, n_after_nulls and what each step removed."""
    each = df.groupBy(_text_key(text_col).alias("k"), F.col(label_col).alias("l")).agg(F.count("*").alias("n"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_after_dedup"), F.count_if(F.col("k").isNotNull() & F.col("l").isNotNull()).alias("n_after_nulls"))
    return sums.select("n_rows", "n_after_dedup", "n_after_nulls", (F.col("n_rows") - F.col("n_after_dedup")).alias("n_repeats"), (F.col("n_after_dedup") - F.col("n_after_nulls")).alias("n_with_nulls"))
