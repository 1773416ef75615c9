"""Large CSV files whose quoted values may hold line breaks, read by all executors at once (A1).

A reader that starts in the middle of a file doesn't know whether it is inside quotes. So the file is read as lines, by byte ranges,
and the quotes are counted: a line begins a record if an even number of quotes lies before it. Each range tells how many
quotes it has, and how many of its lines would begin a record in either state; the running sums of these few numbers give each range
its state and its first record's number. Lines of one record, which may lie in several ranges, are joined by that number. A value that holds a quote must
be quoted itself, with the quote doubled, as the format has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.scratch import stored


def records(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, record (from 1, the header) and text of every record; a line feed or CR LF ends it."""
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=glob, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # ascends within a range
        F.col("value").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    inside = Window.partitionBy("file", "block").orderBy("at")
    local = lines.withColumn("quotes", quotes.cast("long")).withColumn("odd", ((F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quotes")) % 2).cast("int"))
    counted = stored(local, "lines")
    blocks = counted.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("even"), F.count_if(F.col("odd") == 1).alias("uneven"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    states = blocks.withColumn("state", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    begun = states.withColumn("begun", F.when(F.col("state") == 0, F.col("even")).otherwise(F.col("uneven")))
    offsets = begun.select(F.col("file").alias("f"), F.col("block").alias("b"), "state", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("first"))
    joined = counted.join(offsets, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("begins", (F.col("odd") == F.col("state")).cast("long"))
    numbered = joined.withColumn("record", F.col("first") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = (F.col("begins") == 1) & (F.col("quotes") % 2 == 0)  # most records are one line, and are not moved again
    alone = numbered.where(whole).select("file", "record", F.col("line").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    several = numbered.where(~whole).groupBy("file", "record").agg(parts.alias("parts")).select("file", "record", F.array_join(F.col("parts.line"), "\n").alias("text"))
    return alone.unionByName(several).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def scan(spark: SparkSession, path: str, schema: T.StructType, glob: str, options: dict[str, str]) -> DataFrame:
    """The rows of CSV files with a header, by position."""
    rows = records(spark, path, glob).where("record > 1 and text <> ''")
    return rows.select(F.from_csv("text", schema.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r")).select("r.*")
