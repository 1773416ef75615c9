"""Scans of labelled corpora in CSV and several JSON layouts, and write-once sinks.

A dataset is a file or a folder of shards. Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import csv_ranges, json_ranges
from corpusloom.sources.claims import claim, claim_of, exists, hadoop_path, publish, remove

#: The keys under which a wrapped file may hold its rows, first one present wins.
WRAPPERS = ("data", "samples", "entries", "records")


WHOLE_CSV = 256 << 20
"""Bytes of a CSV file up to which one task reads it."""

WHOLE_JSON = 64 << 20
"""Bytes of a JSON file in the column or row layout up to which it is one value of one task."""


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv", whole: int = WHOLE_CSV) -> DataFrame:
    """A1: CSV with a header; values may span lines, quotes are doubled. Files are read whole, each by a task, or all by ranges if one is larger than `whole` bytes; the rows are the same."""
    options = {"escape": '"', "emptyValue": ""}
    if _largest(spark, path) > whole:
        return csv_ranges.scan(spark, path, schema, glob, options)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, pathGlobFilter=glob, recursiveFileLookup=True, **options)


def _largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a folder and those below it."""
    at, fs = hadoop_path(spark, path)
    most, files = 0, fs.listFiles(at, True)
    while files.hasNext():
        most = max(most, files.next().getLen())
    return most


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json*") -> DataFrame:
    """A2: one JSON object per line."""
    return spark.read.schema(schema).json(path, pathGlobFilter=glob, recursiveFileLookup=True)


def discover(spark: SparkSession, path: str, schema: T.StructType, filename: str | None = None) -> DataFrame:
    """A3: the CSV shards of a folder and those below it, or its JSON-lines shards if it has none; an error if it has neither, a warning if it has both.

    filename narrows the choice to a name. Just what is listed is read, wherever it lies.
    """
    names = shard_names(spark, path)
    if filename:
        names = {n for n in names if n == filename}
    kinds = [(suffix, scan) for suffix, scan in ((".csv", scan_csv), (".jsonl", scan_jsonl)) if any(n.endswith(suffix) for n in names)]
    if len(kinds) > 1:
        warnings.warn(f"{path} has .csv and .jsonl files; the .csv files are read", stacklevel=2)
    for suffix, scan in kinds:
        return scan(spark, path, schema, filename or f"*{suffix}")
    raise FileNotFoundError(f"no .csv or .jsonl file in {path}" + (f" named {filename}" if filename else ""))


def shard_names(spark: SparkSession, path: str) -> set[str]:
    """The names of the files of a folder and those below it, but for hidden ones."""
    at, fs = hadoop_path(spark, path)
    found, files = set(), fs.listFiles(at, True)
    while files.hasNext():
        below = files.next().getPath().toUri().getPath()[len(at.toUri().getPath()) :].strip("/") or at.getName()
        if not any(part.startswith(("_", ".")) for part in below.split("/")):
            found.add(below.rsplit("/", 1)[-1])
    return found


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: each file is a JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True)


def scan_json_wrapped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A5: each file is an object with its rows under one of WRAPPERS."""
    outer = T.StructType([T.StructField(k, T.ArrayType(schema)) for k in WRAPPERS])
    rows = _whole(spark, path).select(F.from_json("value", outer).alias("j")).select(F.coalesce(*(F.col(f"j.{k}") for k in WRAPPERS)).alias("rows"))
    return rows.select(F.inline("rows"))


def scan_json_columnar(spark: SparkSession, path: str, schema: T.StructType, whole: int = WHOLE_JSON) -> DataFrame:
    """Each file is an object {column: {row: value}}; rows are those of the first column. All are read by ranges if one is larger than `whole` bytes; the rows are the same."""
    if _largest(spark, path) > whole:
        return json_ranges.columnar(spark, path, schema)
    outer = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType)) for f in schema])
    columns = _whole(spark, path).select(F.from_json("value", outer).alias("j")).select("j.*")
    first, *rest = schema.names
    exploded = columns.select(F.explode(first).alias("__row", first), *(F.col(c).alias(f"__{c}") for c in rest))
    return exploded.select(first, *(F.col(f"__{c}")[F.col("__row")].alias(c) for c in rest))


def scan_json_rowkeyed(spark: SparkSession, path: str, schema: T.StructType, whole: int = WHOLE_JSON) -> DataFrame:
    """Each file is an object {row: {column: value}}. All are read by ranges if one is larger than `whole` bytes; the rows are the same."""
    if _largest(spark, path) > whole:
        return json_ranges.rowkeyed(spark, path, schema)
    rows = _whole(spark, path).select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema))).alias("row", "v"))
    return rows.select("v.*")


SCANS = {"csv": scan_csv, "jsonl": scan_jsonl, "records": scan_json_records, "wrapped": scan_json_wrapped, "columnar": scan_json_columnar, "rowkeyed": scan_json_rowkeyed}


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def sink_json_files(df: DataFrame, path: str, layout: str, shard: str, key: str, mode: str = "errorifexists") -> None:
    """Writes one file per value of the column shard in a whole-file layout of SCANS; the shards should be small."""
    columns = [c for c in df.columns if c != shard]
    row = F.struct(*columns)
    key_of = F.col(key).cast("string")
    if layout == "records":
        value = F.to_json(F.collect_list(row))
    elif layout == "wrapped":
        pick = F.pmod(F.col(shard), F.lit(len(WRAPPERS)))
        rows = F.collect_list(row)
        value = F.to_json(F.struct(*(F.when(F.min(pick) == i, rows).alias(k) for i, k in enumerate(WRAPPERS))))
    elif layout == "columnar":
        value = F.to_json(F.struct(*(F.map_from_entries(F.collect_list(F.struct(key_of, F.col(c)))).alias(c) for c in columns)))
    elif layout == "rowkeyed":
        value = F.to_json(F.map_from_entries(F.collect_list(F.struct(key_of, row))))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    df.groupBy(shard).agg(value.alias("value")).write.mode(mode).partitionBy(shard).text(path)


def save_split(split: DataFrame, path: str, overwrite: bool = False) -> None:
    """A split is written once, as a whole; a second time only with overwrite. Of two jobs at once, one gets a FileExistsError."""
    spark, lock = split.sparkSession, claim_of(path, "split")
    if overwrite:
        split.write.mode("overwrite").parquet(path)
        return
    claim(spark, lock)
    try:
        if exists(spark, path):
            raise FileExistsError(f"there is a split at {path}; pass overwrite=True to replace it")
        publish(split, path)
    finally:
        remove(spark, lock)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """A saved split; an error if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no split at {path}")
    return spark.read.parquet(path)


class Claims:
    """Claims of (experiment, fold) pairs of a table of metrics. They stay, so that a pair is written once; those of a failed job go."""

    def __init__(self, spark: SparkSession, path: str, pairs: list[tuple[str, int]]):
        self.spark, self.path, self.pairs, self.taken = spark, path, sorted(pairs), []

    def __enter__(self) -> Claims:
        try:
            for pair in self.pairs:
                if exists(self.spark, f"{self.path}/exp_id={pair[0]}/fold={pair[1]}"):
                    raise FileExistsError("written before there were claims")
                claim(self.spark, claim_of(self.path, *pair))
                self.taken.append(pair)
        except FileExistsError as e:
            self.release()
            raise FileExistsError(f"metrics of {pair[0]}, fold {pair[1]} are there, or being made ({e}); pass overwrite=True to replace them") from None
        return self

    def __exit__(self, kind, *_) -> None:
        if kind:
            self.release()

    def release(self) -> None:
        for pair in self.taken:
            remove(self.spark, claim_of(self.path, *pair))
        self.taken.clear()


def _pairs(metrics: DataFrame) -> list[tuple[str, int]]:
    return [(r.exp_id, r.fold) for r in metrics.select("exp_id", "fold").distinct().collect()]  # one per run


def save_metrics(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """Metrics rows by (exp_id, fold), each pair written once, as a whole, unless overwrite, which replaces just these pairs."""
    if overwrite:
        metrics.write.partitionBy("exp_id", "fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    with Claims(metrics.sparkSession, path, _pairs(metrics)):
        publish(metrics, path, ["exp_id", "fold"])


def load_metrics(spark: SparkSession, path: str, holdout: bool | None = None) -> DataFrame:
    """Saved metrics; holdout=True: only fold -1, False: only the others. Partitions are pruned."""
    rows = spark.read.parquet(path).withColumn("exp_id", F.col("exp_id").cast("string"))
    if holdout is None:
        return rows
    return rows.where("fold = -1" if holdout else "fold <> -1")
