"""What is written once, by one job of several, and as a whole."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import models, split
from corpusloom.plans import experiment
from corpusloom.sources import claims
from corpusloom.sources import corpus_files as files
from corpusloom.sources.scratch import new_path


def outcomes(*jobs):
    """What each of some jobs at once gives, or its error."""

    def of(job):
        try:
            return job()
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(of, jobs))


def test_one_of_many_gets_a_claim(spark):
    path = new_path(spark, "claim") + "/deep/claim"
    got = outcomes(*[lambda: claims.claim(spark, path)] * 8)
    assert got.count(None) == 1 and sum(isinstance(x, FileExistsError) for x in got) == 7
    claims.remove(spark, path)
    claims.claim(spark, path)


def test_one_of_two_splits_is_saved(spark):
    path = new_path(spark, "split")
    rows = [spark.range(100 * i).select(F.col("id").alias("row_id"), F.lit(i).alias("label")) for i in (1, 2)]
    got = outcomes(*[lambda r=r: files.save_split(r, path) for r in rows])
    assert sum(isinstance(x, FileExistsError) for x in got) == 1
    saved = files.load_split(spark, path)
    assert saved.count() == 100 * saved.first().label  # one of them, whole
    with pytest.raises(FileExistsError, match="overwrite"):
        files.save_split(rows[0], path)
    files.save_split(rows[0], path, overwrite=True)
    assert files.load_split(spark, path).count() == 100


def test_a_failed_save_leaves_nothing(spark):
    path = new_path(spark, "split")
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("row_id"))
    with pytest.raises(Exception, match="no"):
        files.save_split(bad, path)
    assert not claims.exists(spark, path) and not claims.exists(spark, claims.claim_of(path, "split"))
    metrics = spark.createDataFrame([("a/b", 0, 0.5)], "exp_id string, fold int, f1 double")
    with pytest.raises(Exception, match="no"):
        files.save_metrics(metrics.withColumn("f1", F.when(F.col("f1") > 0, F.raise_error(F.lit("no")).cast("double"))), path)
    files.save_metrics(metrics, path)
    assert files.load_metrics(spark, path).first().exp_id == "a/b"


def test_metrics_by_pairs(spark):
    path = new_path(spark, "metrics")
    rows = spark.createDataFrame([("e", i, i / 10) for i in range(-1, 3)], "exp_id string, fold int, f1 double")
    got = outcomes(*[lambda f=f: files.save_metrics(rows.where(f"fold = {f}"), path) for f in (-1, 0, 0, 1)])
    assert sum(isinstance(x, FileExistsError) for x in got) == 1
    with pytest.raises(FileExistsError, match="fold 1"):
        files.save_metrics(rows.where("fold > 0"), path)
    files.save_metrics(rows.where("fold = 2"), path)  # the failed one gave fold 2 back
    assert sorted((r.fold, r.f1) for r in files.load_metrics(spark, path).collect()) == [(i, i / 10) for i in range(-1, 3)]


def test_the_holdout_is_scored_once(spark):
    corpus = spark.createDataFrame([(i, f"w{i % 4} x{i % 3} y", int(i % 4 == 0)) for i in range(60)], "row_id long, func string, target int")
    sides = split.stratified_holdout(corpus, "row_id", "target")
    cv = experiment.CrossValidation(split.attach_fold(corpus, sides, split.stratified_kfold(sides, 2), "row_id"), high=1, max_features=50, k=2)
    path, fits = new_path(spark, "metrics"), []

    def fit(train):
        fits.append(1)
        return models.weighted_logistic(train, tol=1e-4)

    def broken(train):
        raise ArithmeticError("no model")

    with pytest.raises(ArithmeticError):
        cv.holdout("EXP_0", broken, path)
    got = outcomes(*[lambda: cv.holdout("EXP_0", fit, path)] * 2)
    assert sum(isinstance(x, FileExistsError) for x in got) == 1 and len(fits) == 1  # the other one didn't score
    assert files.load_metrics(spark, path, holdout=True).count() == 1
    other = experiment.CrossValidation(split.attach_fold(corpus, sides, split.stratified_kfold(sides, 2), "row_id"), high=1, max_features=50, k=2)
    with pytest.raises(FileExistsError):
        other.holdout("EXP_0", fit, path)
    assert len(fits) == 1


def test_shards_below_a_folder(spark):
    path = new_path(spark, "shards")
    schema = T.StructType([T.StructField("row_id", T.LongType())])
    spark.range(3).select(F.col("id").alias("row_id")).write.csv(f"{path}/a/b", header=True)
    spark.range(2).select(F.col("id").alias("row_id")).write.json(f"{path}/_hidden")
    assert files.discover(spark, path, schema).count() == 3
    one = spark.range(5).select(F.col("id").alias("row_id"))
    one.coalesce(1).write.json(f"{path}/c")
    names = files.shard_names(spark, path)
    assert len([n for n in names if n.endswith(".json")]) == 1
    with pytest.raises(FileNotFoundError):
        files.discover(spark, f"{path}/c", schema)
