"""Large whole-file JSON in the column and row layouts, read by all executors at once.

A file is one object, so a reader that starts in its middle knows neither whether it is inside a string nor how deep. Files
are read by byte ranges, as the segments between quotes. A quote behind an odd number of backslashes is part of a string; each other one begins or ends
one. Each range tells how many of these it has, and how far its brackets lead down in either state; the running sums of these few
numbers give each range its state and depth. Then a segment outside strings that ends in `{` or `,` begins a key of its depth. Keys are
counted in the same way, and the segments from one key to the next, which may lie in several ranges, are joined by that count: a row of the one
layout, a value of the other, whose columns are then put together by the row's key.

Files must be well-formed. Those without rows give none. Of keys given twice in a file, one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.sides import few
from corpusloom.sources.scratch import stored

_RANGE = ["file", "block"]


def _in_range(to: int) -> WindowSpec:
    """The segments of a range up to this one (0), or before it (-1)."""
    return Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, to)


def _ranges_before() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range


def _rtrim(text: str | Column) -> Column:
    return F.rtrim(text, F.lit(" \t\r\n"))


def _sum(value: Column, over: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(over), F.lit(0))


def _count(column: str, letters: str) -> Column:
    return F.length(column) - F.length(F.translate(column, letters, ""))


def _join(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments with what is known of their ranges."""
    side = few(ranges.withColumnsRenamed({"file": "f", "block": "b"}))
    return segments.join(side, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (ascending within a range), line, state-free facts of each segment, and outside and depth (at its end)."""
    lines = spark.read.text(path, lineSep='"', recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    slashes = F.length("line") - F.length(F.rtrim("line", F.lit("\\")))
    facts = lines.select(
        "*",
        (slashes % 2 == 0).cast("long").alias("quote"),
        (_count("line", "{[") - _count("line", "}]")).cast("long").alias("down"),
        F.right(_rtrim("line"), F.lit(1)).alias("tail"),
    )
    kept = stored(facts.withColumn("odd", _sum(F.col("quote"), _in_range(-1)) % 2), "segments")
    sums = kept.groupBy(*_RANGE).agg(F.sum("quote").alias("quotes"), *(F.sum(F.when(F.col("odd") == i, F.col("down")).otherwise(0)).alias(f"down{i}") for i in (0, 1)))
    states = sums.withColumn("state", _sum(F.col("quotes"), _ranges_before()) % 2)
    starts = states.select(*_RANGE, "state", _sum(F.when(F.col("state") == 0, F.col("down0")).otherwise(F.col("down1")), _ranges_before()).alias("start"))
    outside = F.col("odd") == F.col("state")
    return _join(kept, starts).withColumn("outside", outside).withColumn("depth", F.col("start") + _sum(F.when(outside, F.col("down")).otherwise(0), _in_range(0)))


def entries(spark: SparkSession, path: str, level: int) -> DataFrame:
    """file, column, depth, entry: every key of that depth or less with its value, as an object of its own; column: the number of keys of depth 1 so far. Of shallower keys, entry is but a beginning."""
    begins = F.when(F.col("outside") & F.col("tail").isin("{", ",") & F.col("depth").between(1, level), F.col("depth"))
    placed = segments(spark, path).withColumn("begins", begins)
    keys = {"record": F.col("begins").isNotNull().cast("long"), "column": F.coalesce(F.col("begins") == 1, F.lit(False)).cast("long")}
    counts = placed.groupBy(*_RANGE).agg(*(F.sum(v).alias(f"n_{k}") for k, v in keys.items()))
    firsts = counts.select(*_RANGE, *(_sum(F.col(f"n_{k}"), _ranges_before()).alias(f"first_{k}") for k in keys))
    numbered = _join(placed, firsts).select("file", "block", "at", "line", "depth", *((F.col(f"first_{k}") + _sum(v, _in_range(-1))).alias(k) for k, v in keys.items()))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line", "depth")))
    grouped = numbered.where("record > 0").groupBy("file", "record").agg(F.max("column").alias("column"), parts.alias("parts"))
    text = grouped.select("file", "column", F.col("parts")[0]["depth"].alias("depth"), F.element_at("parts", -1)["depth"].alias("end"), _rtrim(F.array_join("parts.line", '"')).alias("text"))
    bare = _rtrim(F.when(F.endswith("text", F.lit(",")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    closed = F.when(F.col("end") >= level, F.concat("bare", F.lit("}"))).when(F.col("end") == level - 1, F.col("bare")).otherwise(F.expr("left(bare, length(bare) - 1)"))
    return text.withColumn("bare", bare).select("file", "column", "depth", F.concat(F.lit('{"'), closed).alias("entry"))


def rowkeyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """{row: {column: value}}."""
    rows = entries(spark, path, 1).select(F.explode(F.from_json("entry", T.MapType(T.StringType(), schema))).alias("row", "v"))
    return rows.select("v.*")


def _key() -> Column:
    raw = F.regexp_extract("entry", r'^\{"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    return F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), T.ArrayType(T.StringType()))[0]


def columnar(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """{column: {row: value}}; rows are those of the first column of the schema."""
    keyed = stored(entries(spark, path, 2).withColumn("key", _key()), "entries")
    names = few(keyed.where("depth = 1").select(F.col("file").alias("f"), F.col("column").alias("c"), F.col("key").alias("name")).where(F.col("name").isin(schema.names)))
    values = keyed.where("depth = 2").join(names, (F.col("file") == F.col("f")) & (F.col("column") == F.col("c")))
    value_of = lambda f: F.when(F.col("name") == f.name, F.map_values(F.from_json("entry", T.MapType(T.StringType(), f.dataType)))[0])
    picked = [F.first(value_of(f), ignorenulls=True).alias(f"v{i}") for i, f in enumerate(schema)]
    rows = values.groupBy("file", "key").agg(F.max(F.col("name") == schema.names[0]).alias("there"), *picked).where("there")
    return rows.select(*(F.col(f"v{i}").alias(f.name) for i, f in enumerate(schema)))
