"""Results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import batching, clean, metrics, profile, rank, split, tfidf
from corpusloom.sources import corpus_files as files
from corpusloom.sources.scratch import new_path


def scores(spark, *rows):
    return spark.createDataFrame([("e", 0, y, s) for y, s in rows], "exp_id string, fold int, label int, score double")


@pytest.mark.parametrize(
    "rows, area",
    [
        ([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], 5 / 6),
        ([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], 0.5),
        ([(0, 0.9), (0, 0.2)], 0.0),
    ],
)
def test_average_precision(spark, rows, area):
    assert metrics.average_precision(scores(spark, *rows)).first().pr_auc == pytest.approx(area)


def test_precision_recall(spark):
    one = lambda *rows: tuple(metrics.precision_recall_f1(scores(spark, *rows)).first())[2:]
    assert one((1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)) == pytest.approx((2 / 3, 1, 0.8))
    assert one((1, 0.1), (0, 0.2)) == (0, 0, 0)
    assert one((1, 0.5)) == (1, 1, 1)
    assert metrics.aggregate_folds(metrics.evaluate(scores(spark, (1, 0.5)))).first().std_f1 is None


def test_weights(spark):
    of = lambda labels: [r.weight for r in metrics.class_weights(spark.createDataFrame([(x,) for x in labels], "y int"), "y").orderBy("label").collect()]
    assert of([0, 0, 0, 1]) == pytest.approx([2 / 3, 2])
    assert of([0, 2])[1] == 0
    with pytest.raises(ValueError):
        of([])
    with pytest.raises(ValueError):
        of([-1, 0])


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("int __x1 = 0x1F + 12ab;",), ("",), (None,)], "s string")
    rows = df.select(X.code_tokens(X.normalize_text(F.col("s"))).alias("t")).collect()
    assert [r.t for r in rows] == [["int", "__x1", "0x1f"], [], None]
    grams = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>").select(X.word_ngrams(F.col("t"), 1, 3).alias("g")).collect()
    assert grams[0].g == ["a", "b", "c", "a b", "b c", "a b c"] and grams[1].g == []
    chars = spark.createDataFrame([("a  bé",), ("",), ("x",)], "s string").select(X.char_ngrams(F.col("s"), 1, 2).alias("g")).collect()
    assert chars[0].g == ["a", " ", "b", "é", "a ", " b", "bé"] and chars[1].g == [] and chars[2].g == ["x"]


def test_lengths_and_categories(spark):
    df = spark.createDataFrame([(None,), ("",), ("123456789",)], "s string")
    assert [r[0] for r in df.select(X.approx_token_len(F.col("s"))).collect()] == [0, 1, 2]
    tags = spark.createDataFrame([("[CWE-119, CWE-787]",), ("CWE-125",), ("['A', 'B']",)], "s string")
    assert [r[0] for r in tags.select(X.parse_categories(F.col("s"))).collect()] == [["CWE-119", "CWE-787"], ["CWE-125"], ["A", "B"]]
    assert tags.select(X.parse_categories(F.col("s"), strict=True)).collect()[2][0] == ["A'", "'B"]


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],)], "ids array<int>")
    right, mask = X.truncate_pad_mask(F.col("ids"), 8, F.lit(3))
    left, _ = X.truncate_pad_mask(F.col("ids"), 8, F.lit(3), side="left")
    row = df.select(right.alias("r"), mask.alias("m"), left.alias("l")).collect()[1]
    assert (row.r, row.m, row.l) == ([4, 0, 0], [1, 0, 0], [0, 0, 4])
    with pytest.raises(ValueError):
        X.truncate_pad_mask(F.col("ids"), 8, F.lit(3), side="up")


def test_quota_and_invariants(spark):
    df = spark.createDataFrame([(i, int(i >= 7)) for i in range(10)], "row_id long, target int")
    held = split.stratified_holdout(split.check_size(df), "row_id", "target").where("split = 'holdout'").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in held} == {0: 1, 1: 1}
    big = spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("target"))
    sides = split.stratified_holdout(big, "row_id", "target")
    again = split.stratified_holdout(big.repartition(7), "row_id", "target")
    assert sides.exceptAll(again).isEmpty()
    folds = split.stratified_kfold(sides, 5)
    sizes = [r["count"] for r in folds.groupBy("label", "fold").count().collect() if r.label == 0]
    assert max(sizes) - min(sizes) <= 1 and folds.count() == sides.where("split = 'train'").count()
    with pytest.raises(ValueError):
        split.check_size(df.limit(3))


def test_idf_and_leakage(spark):
    counts = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "b", 1)], "row_id long, term string, tf long")
    vocabulary = tfidf.build_vocabulary(counts, n_rows=3)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert idf["a"] == pytest.approx(math.log(2) + 1)
    pipeline = tfidf.TfidfPipeline(high=1)
    with pytest.raises(RuntimeError):
        pipeline.transform(counts)
    train = spark.createDataFrame([(1, "x y x"), (2, None)], "row_id long, func string")
    pipeline.fit(train)
    unseen = spark.createDataFrame([(9, "x q"), (8, "q")], "row_id long, func string")
    w = pipeline.transform(unseen).collect()
    assert [(r.row_id, r.term) for r in w] == [(9, "x")] and w[0].w == pytest.approx(1.0)
    vectors = tfidf.sparse_vectors(pipeline.transform(unseen), unseen.select("row_id"), 2).collect()
    assert {r.row_id: r.features.numNonzeros() for r in vectors} == {9: 1, 8: 0}


def test_ranks(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"))
    got = sorted(r.position for r in rank.epoch_shuffle(df, "row_id", 1, 2).collect())
    assert got == list(range(1, 501)) and rank.sample_n(df, "row_id", 7, 3).count() == 7 and rank.sample_n(df, "row_id", 999, 3).count() == 500
    batches = batching.assemble_batches(df.select("row_id", F.array_repeat(F.lit(1), (F.col("row_id") % 9).cast("int")).alias("ids")), "row_id", "ids", by_length=True)
    waste = batching.padding_waste(batches).first()
    assert waste.n_rows == 500 and waste.n_batches == 63 and waste.waste < 0.05


def test_cleaning(spark):
    df = spark.createDataFrame([(2, "a", 0), (1, "a", 0), (3, "a", 1), (4, None, 0), (5, None, 0)], "row_id long, func string, target int")
    assert sorted(r.row_id for r in clean.dedup(df, "func", "target", "row_id").collect()) == [1, 3, 4]
    assert clean.label_conflicts(df, "func", "target").count() == 1
    with pytest.raises(ValueError):
        clean.validate_labels(df.withColumn("target", F.lit(7)), "target")
    with pytest.raises(ValueError):
        clean.require_columns(df, ["nope"])
    assert clean.resolve_column(df, "tags") is None
    labels = df.select(F.explode(F.array(F.lit("1"), F.lit('{"0": 0}'), F.lit("x"))).alias("v")).limit(3)
    assert [r[0] for r in labels.select(X.coerce_label(F.col("v"))).collect()] == [1, 0, None]
    assert profile.class_distribution(df, "target").count() == 2


def test_write_once(spark):
    rows = spark.createDataFrame([("e", -1, 0.5)], "exp_id string, fold int, f1 double")
    path = new_path(spark, "metrics")
    files.save_metrics(rows, path)
    with pytest.raises(FileExistsError):
        files.save_metrics(rows, path)
    files.save_metrics(rows.withColumn("f1", F.lit(0.7)), path, overwrite=True)
    assert [r.f1 for r in files.load_metrics(spark, path, holdout=True).collect()] == [0.7]
    with pytest.raises(FileNotFoundError):
        files.load_split(spark, new_path(spark, "none"))


def test_pairs_of_labels_and_scores(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "row_id long, fold int, label int")
    scores = spark.createDataFrame([(2, 0, 0.25), (1, 0, 0.5)], "row_id long, fold int, score double")
    out = metrics.pair_scores(labels, scores, ["row_id", "fold"])
    assert out.columns == ["row_id", "fold", "label", "score"] and sorted(map(tuple, out.collect())) == [(1, 0, 1, 0.5), (2, 0, 0, 0.25)]
    with pytest.raises(ValueError, match="1 labels without a score, 0 scores"):
        metrics.pair_scores(labels, scores.where("row_id = 1"), ["row_id", "fold"])
