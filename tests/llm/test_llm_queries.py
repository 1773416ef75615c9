"""The registered queries over the smallest tables, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from corpusloom.llm import queries
from corpusloom.llm.shared import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_collocations"}))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    key = next(c for c in ("doc_id", "page_id", "conv_id") if c in out.columns)
    source = {"doc_id": "documents", "page_id": "pages", "conv_id": "conversations"}[key]
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}
    got = [r[0] for r in out.select(key).collect()]
    assert len(got) == len(set(got)) and set(got) == ids | ({-1} if key == "conv_id" else set())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*names).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        n = out.count()
        assert 0 < n <= before and (i != 2 or n == before)
        before, docs = n, out
    ids = corpus_pipeline.run(spark, SF)
    assert ids.columns == ["doc_id", "n_tokens", "ids"] and 0 < ids.count() < first


def test_pipeline_with_odd_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = [tuple(r[n] for n in names) for r in rows]
    long = " ".join(f"word{i}" for i in range(30_000))
    odd += [(None, odd[0][1], "en", "x", None), (7001, None, None, None, None), (7002, "", "en", None, 0), (7003, long, None, "web", 1), (7004, long, "en", "web", 1), odd[1], odd[1]]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "row", "of", "class_id", "__p", "topic", "u", "kept"):
        docs = docs.withColumn(c, F.lit("clash"))
    for frame in (docs, docs.where("false")):
        kept = frame
        for name, stage in corpus_pipeline.STAGES:
            before = {r.doc_id for r in kept.collect()}
            kept = stored(stage(spark, kept, SF), "odd")
            assert {r.doc_id for r in kept.collect()} <= before, name
            assert kept.columns == (frame.columns if name != "byte-level BPE" else ["doc_id", "n_tokens", "ids"])
            ids = [r.doc_id for r in kept.collect()]
            if name == "quality rules":
                assert not {7001, 7002} & set(ids) and (frame is not docs or {7003, 7004} <= set(ids))
            if name == "near duplicates":
                assert 7004 not in ids and (frame is not docs or 7003 in ids)
        assert (kept.count() > 0) == (frame is docs)
