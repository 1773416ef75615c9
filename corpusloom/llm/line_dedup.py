"""Operator 13: removal of lines that documents share, in DataFrame functions only.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends, with A-Z in lower case. Keys of at least
`least` code points that at least `documents` documents hold keep their lines in one document, that of the largest id.

keep_bitmaps() is the operator. Hashes of keys are dealt by range partitioning and sorted by hash, then by document and
position, so that each partition is streamed key by key: the first rows of a key are those of the document that keeps it. What
comes back is no text but a bitmap of kept lines per document, compressed as the runs of its ones (start, length). apply() takes
a text's kept lines by its bitmap.

A key may hold any share of the lines (a licence line, a menu). The quantiles of all hashes tell which ones fill a range by
themselves: such a key is a quantile twice at least, so there are QUANTILES / 2 of them at most, or one per four partitions. Their rows are
pre-aggregated to the number of documents and the largest id, and matched by a broadcast of these few rows; they are never
gathered. All other keys are smaller than a range, and are streamed.

Hashes have 128 bits, so two keys share one with a chance of n^2 / 2^129: 10^-15 at 10^12 distinct keys.

Null or empty text: one empty line. Rows of equal id are one document when documents are counted, also those without id, which
rank below every id; each such row has its own bitmap, by the content of its text. Repeated rows fare alike. Empty table: none. Long texts are
split whole. Only id and text are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import Steps, ascii_lower, stored

QUANTILES = 1000
"""Cuts of the hashes, at least; four per shuffle partition if that is more."""

_PARTITION_CUTS = 4

_BLANK = " \t\n\x0b\x0c\r"
_RUN = "array<struct<start:int,length:int>>"


def key_of(line: Column) -> Column:
    """The line without white space at both ends, with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, lines and version, a hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.split(text, "\n").alias("lines"))


def _hashed(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """h1, h2, id, version and position of every line whose key is long enough."""
    lines = _rows(df, id_col, text_col).select("id", "version", F.posexplode("lines").alias("position", "line"))
    keyed = lines.select("id", "version", "position", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "id", "version", "position")


def _crowded(hashed: DataFrame) -> DataFrame:
    """The high bits (prefix) of hashes that fill a range by themselves."""
    cuts = max(QUANTILES, _PARTITION_CUTS * int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    points = hashed.agg(F.percentile_approx(_prefix(), at, 10 * cuts).alias("p")).select(F.explode("p").alias("prefix"))
    return points.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix")


def _prefix() -> Column:
    """The upper 48 bits, which quantiles hold without loss."""
    return F.shiftright("h1", 16)


def _stream(hashed: DataFrame, documents: int) -> DataFrame:
    """id, version and position of the lines that go, key by key."""
    dealt = hashed.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("id"), "version", "position")
    key = Window.partitionBy("h1", "h2")
    nth = F.dense_rank().over(key.orderBy(F.desc_nulls_last("id")))  # the document's number within the key; the first one keeps it
    counted = dealt.withColumn("nth", nth).withColumn("of", F.max("nth").over(key))
    return counted.where((F.col("nth") > 1) & (F.col("of") >= documents)).select("id", "version", "position")


def _filled(hashed: DataFrame, documents: int) -> DataFrame:
    """The same of rows whose key fills a range: counted first, then matched by a broadcast."""
    each = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    known = each.groupBy("h1", "h2").agg(F.count("*").alias("of"), F.max("id").alias("keeper")).where(F.col("of") >= documents)
    side = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper")
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    return hashed.join(F.broadcast(side), same).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "version", "position")


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """id, version, n_dropped and keep of every document that loses lines: the runs of line numbers (from 0) up to the last lost line, that are kept.

    A document without a row here keeps all its lines.
    """
    with Steps() as steps:
        hashed = steps.stored(_hashed(df, id_col, text_col, least), "lines")
        crowded = steps.stored(_crowded(hashed), "crowded")
        marked = hashed.join(F.broadcast(crowded.select(F.col("prefix").alias("p"), F.lit(True).alias("hot"))), _prefix() == F.col("p"), "left")
        rest, filled = marked.where("hot is null").select(*hashed.columns), marked.where("hot").select(*hashed.columns)
        gone = _stream(rest, documents).unionByName(_filled(filled, documents))
        lost = gone.groupBy("id", "version").agg(F.array_sort(F.collect_set("position")).alias("lost"))
        # A run of ones lies before every lost line whose predecessor is kept.
        before = F.transform("lost", lambda p, i: F.struct(F.when(i > 0, F.col("lost")[i - 1] + 1).otherwise(F.lit(0)).alias("start"), p.alias("end")))
        runs = F.transform(F.filter(before, lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))
        return stored(lost.select("id", "version", F.size("lost").alias("n_dropped"), F.element_at("lost", -1).alias("last"), runs.cast(_RUN).alias("keep")), "bitmaps")


def apply(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, keep (runs of all kept lines) and text of every row, its kept lines joined by line feeds."""
    marks = bitmaps.select(F.col("id").alias("of"), F.col("version").alias("of_version"), "n_dropped", "last", F.col("keep").alias("head"))
    rows = _rows(df, id_col, text_col)
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    n = F.size("lines")
    tail = F.struct((F.coalesce("last", F.lit(-1)) + 1).alias("start"), (n - 1 - F.coalesce("last", F.lit(-1))).alias("length"))
    keep = F.filter(F.concat(F.coalesce("head", F.array().cast(_RUN)), F.array(tail).cast(_RUN)), lambda r: r["length"] > 0)
    known = joined.select("id", n.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep"), "lines")
    text = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(F.col("lines"), r["start"] + 1, r["length"]))), "\n")
    return known.select("id", "n_lines", "n_dropped", "keep", text.alias("text"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 and kept_runs (the bitmap, as start+length of its runs, comma-joined), after the bitmaps were applied."""
    kept_runs = F.array_join(F.transform("keep", lambda r: F.concat_ws("+", r["start"], r["length"])), ",")
    out = apply(df, keep_bitmaps(df, id_col, text_col), id_col, text_col)
    return out.select("id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), kept_runs.alias("kept_runs"))


_SQL_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {_SQL_BLANK}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.key IS NULL OR k.doc_id = s.keeper AS stays FROM keyed k LEFT JOIN shared s ON k.key = s.key),
each AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM marked GROUP BY doc_id),
edges AS (SELECT *, stays AND NOT coalesce(lag(stays) OVER w, false) AS opens, stays AND NOT coalesce(lead(stays) OVER w, false) AS closes
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
opened AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM edges WHERE opens),
closed AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM edges WHERE closes),
runs AS (SELECT o.doc_id, string_agg((o.pos - 1) || '+' || (c.pos - o.pos + 1), ',' ORDER BY o.pos) AS kept_runs
  FROM opened o JOIN closed c ON o.doc_id = c.doc_id AND o.i = c.i GROUP BY o.doc_id)
SELECT each.*, coalesce(kept_runs, '') AS kept_runs FROM each LEFT JOIN runs ON each.doc_id = runs.doc_id
"""
