"""Exact quantiles from counts against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import profile


def test_quantiles_of_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(v)) for k, v in zip(rng.choice([0, 1, 1, 1], 501), rng.geometric(0.02, 501), strict=True)] + [(2, 7), (None, 3), (None, 8)]
    df = spark.createDataFrame(rows, "target int, n int")
    got = {(r.label, r.is_all): r for r in profile.length_stats(df, "target", "x", F.col("n")).collect()}
    for label in (0, 1, 2, None, "all"):
        values = [v for k, v in rows if label == "all" or k == label]
        r = got[(None, 1) if label == "all" else (label, 0)]
        assert (r.median_len, r.p95_len, r.p99_len) == pytest.approx(tuple(np.quantile(values, [0.5, 0.95, 0.99])))
        assert r.mean_len == pytest.approx(np.mean(values)) and r.max_len == max(values) and r.suggested_len == int(np.quantile(values, 0.95))
    cut = profile.clipped_length_stats(df, F.col("n"), 60).first()
    values = np.minimum([v for _, v in rows], 60)
    assert (cut.n, cut.median_len, cut.p95_len) == pytest.approx((len(rows), *np.quantile(values, [0.5, 0.95])))
    assert cut.pct_truncated == pytest.approx(100 * np.mean([v > 60 for _, v in rows]))
    plan = profile.length_stats(df, "target", "x", F.col("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
