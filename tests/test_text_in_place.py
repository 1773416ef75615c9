"""Text functions without Python workers and without a shuffle."""

import random
import unicodedata

from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as X
from corpusloom.operators import tfidf

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_accents_of_every_code_point(spark):
    """As the library for Unicode has it, alone and between others; Spark's lower case is taken as it is."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) != "Cn"]
    rng = random.Random(3)
    mixed = ["".join(rng.choices(chars[:3_000] + ["한", "가", "힣", "ﬁ", "½", "ﷺ", "é", "a", " "] * 99, k=rng.randint(0, 40))) for _ in range(2_000)]
    texts = ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)] + mixed + ["", None, "plain", "\U0001f100x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), X.normalize_text(F.col("t")).alias("got"))
    assert "Python" not in plan(df)
    for r in df.collect():
        assert r.got == (r.low and "".join(c for c in unicodedata.normalize("NFKD", r.low) if not unicodedata.combining(c)))


def test_ngrams_are_counted_in_their_rows(spark):
    got = plan(catalog.QUERIES["h3_word_ngrams"](spark, SMALL))
    assert "Exchange" not in got and "Python" not in got


def test_no_python_in_texts(spark):
    for name in ("h1_normalize_text", "h2_code_tokens", "h5_sublinear_tf", "h13_truncate_pad_mask"):
        assert "Python" not in plan(catalog.QUERIES[name](spark, SMALL)), name


def test_tokens_of_ids_are_made_twice_only(spark):
    """Once for the vocabulary, once for the ids; no filter makes them again, and no Python worker."""
    got = plan(catalog.QUERIES["h13_truncate_pad_mask"](spark, SMALL))
    assert got.count("0x[0-9a-fA-F]+") == 2 and "Python" not in got


def test_terms_are_dealt_by_size_and_made_once(spark):
    df = spark.createDataFrame([(i, "a b c " * 50) for i in range(40)], "row_id long, func string")
    assert tfidf.parts_of(df, "func", 1_000) == 12
    counts = tfidf.term_counts(df, "row_id", "func", parts=12)
    assert plan(counts).count("0x[0-9a-fA-F]+") == 1  # tokens are found once, not again in a filter
    assert counts.rdd.getNumPartitions() == 12  # not joined by their size before they grow
    built = plan(tfidf.build_vocabulary(counts, 40, parts=7))
    assert "hashpartitioning(term" in built and ", 7)" in built


def test_scales_are_broadcast(spark):
    w = spark.createDataFrame([(1, "a", 2.0), (2, "a", -4.0), (2, "b", 0.0)], "row_id long, term string, w double")
    out = tfidf.max_abs_scale(w, tfidf.max_abs(w))
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert sorted(tuple(r) for r in out.select("row_id", "term", "w").collect()) == [(1, "a", 0.5), (2, "a", -1.0), (2, "b", 0.0)]
