"""Forests grown where their rows are."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusloom.operators import forest, metrics, models
from tests.test_models import points


def scores(df):
    return {r.row_id: r.score for r in df.collect()}


def area(run):
    return metrics.average_precision(run.select(F.lit("e").alias("exp_id"), F.lit(0).alias("fold"), "label", "score")).first().pr_auc


def test_levels_and_tasks_grow_the_same_trees(spark):
    """Nodes split by counts of parts, and in one task; trees at once or in groups; rows in another order."""
    _, _, rows = points(spark)
    _, _, other = points(spark, 200, seed=6)
    plain = forest.grown_scores(rows, other, trees=7, depth=8)
    assert plain.columns == [*other.columns, "score"]
    want = scores(plain)
    assert len(want) == 200 and len(set(want.values())) > 20
    assert scores(forest.grown_scores(rows, other, trees=7, depth=8, node_rows=25, tree_rows=1_500)) == want
    assert scores(forest.grown_scores(rows.orderBy(F.desc("row_id")).repartition(3), other.repartition(2), trees=7, depth=8, node_rows=60)) == want
    assert scores(forest.grown_scores(rows, other, trees=7, depth=8, seed=1)) != want


def test_as_good_as_the_library_forest(spark):
    _, _, rows = points(spark)
    _, _, other = points(spark, 200, seed=6)
    assert area(forest.grown_scores(rows, other, trees=60, depth=30)) > 0.95 * area(models.predict_proba(models.weighted_random_forest(rows, 60, 30), other))


def test_leaves_are_pure_or_at_the_limit(spark):
    """One tree without depth: weighted shares of all drawn rows; with depth, its own rows are told apart."""
    x, y, rows = points(spark)
    flat = set(scores(forest.grown_scores(rows, rows, trees=1, depth=0)).values())
    assert len(flat) == 1
    deep = scores(forest.grown_scores(rows, rows, trees=200, depth=30))
    assert np.mean([(deep[i] > 0.5) == bool(t) for i, t in enumerate(y)]) > 0.97
    one = spark.createDataFrame([(i, Vectors.dense([float(i)]), 0) for i in range(20)], ["row_id", "features", "label"])
    assert set(scores(forest.grown_scores(one, one, trees=3)).values()) == {0.0}


@pytest.mark.parametrize("seed", range(3))
def test_best_split_against_all_splits(seed):
    rng = np.random.default_rng(seed)
    bins, label, times = rng.integers(0, 6, (40, 5)).astype(np.uint8), rng.integers(0, 2, 40), rng.integers(1, 4, 40)
    node, features, w = rng.integers(0, 3, 40), np.array([[0, 2], [1, 4], [3, 4]]), np.array([0.6, 1.7])
    got = forest.best_splits(forest.counted(bins, label, times, node, features), features, w)

    def impure(m):
        a, b = ((times[m & (label == t)]).sum() * w[t] for t in (0, 1))
        return a + b - (a * a + b * b) / (a + b) if a + b else 0.0

    for n in range(3):
        here = node == n
        gains = {(f, b): impure(here) - impure(here & (bins[:, f] <= b)) - impure(here & (bins[:, f] > b)) for f in features[n] for b in range(5) if (here & (bins[:, f] > b)).any() and (here & (bins[:, f] <= b)).any()}
        assert gains[got[0][n], got[1][n]] == pytest.approx(max(gains.values()))
        left = here & (bins[:, got[0][n]] <= got[1][n])
        assert got[2][n].tolist() == [times[left & (label == t)].sum() for t in (0, 1)]
