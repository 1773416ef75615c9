"""Fits whose memory does not grow with all trees or all n-grams."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching, metrics, models
from corpusloom.plans import experiment
from tests.test_models import points


def test_forest_in_groups(spark, monkeypatch):
    """No more trees at a time than the rows allow; all of them in the end, and as good as one forest."""
    _, _, rows = points(spark)
    _, _, other = points(spark, 200, seed=6)
    grown, plain = [], models.weighted_random_forest
    monkeypatch.setattr(models, "weighted_random_forest", lambda t, n, d, s: grown.append((n, s)) or plain(t, n, d, s))
    got = models.forest_scores(rows, other, trees=30, depth=6, most=300 * 12)
    assert [n for n, _ in grown] == [12, 12, 6] and len({s for _, s in grown}) == 3
    parts = [{r.row_id: r.score for r in models.predict_proba(plain(rows, n, 6, s), other).collect()} for n, s in grown]
    for r in got.collect():
        assert r.score == pytest.approx(sum(p[r.row_id] * n for p, (n, _) in zip(parts, grown, strict=True)) / 30)
    area = lambda run: metrics.average_precision(run.select(F.lit("e").alias("exp_id"), F.lit(0).alias("fold"), "label", "score")).first().pr_auc
    assert got.count() == 200 and area(got) > 0.95 * area(models.predict_proba(plain(rows, 30, 6), other))


def test_cross_validation_keeps_known_terms_only(spark):
    rows = [(i, f"a b a{i % 3} only{i}", i % 2, "holdout" if i >= 40 else "train", None if i >= 40 else i % 4) for i in range(50)]
    attached = spark.createDataFrame(rows, "row_id long, func string, target int, split string, fold int")
    cv = experiment.CrossValidation(attached, high=1, max_features=4, k=4)
    kept = cv.terms.select("row_id", F.explode("terms.term").alias("t"))
    assert kept.select("t").distinct().count() <= 4 * 5 < 50
    for fold in range(-1, 4):
        terms = {r.term for r in cv.vocabularies.where(F.col("fold") == fold).collect()}
        inside = [t.split() for i, t, _, s, f in rows if s == "train" and f != fold]
        counts = {w: sum(t.count(w) for t in inside) for t in inside for w in t}
        assert terms == set(sorted(counts, key=lambda w: (-counts[w], w))[:4])


def test_batches_make_their_ids_once(spark):
    made = spark.sparkContext.accumulator(0)

    def ids(n):
        made.add(1)
        return [n] * (n % 5)

    df = spark.range(40).withColumn("ids", F.udf(ids, "array<int>").asNondeterministic()("id"))
    out = batching.assemble_batches(df, "id", "ids", seed=5)
    assert out.count() == 40 and len(out.collect()) == 40
    assert made.value == 40
