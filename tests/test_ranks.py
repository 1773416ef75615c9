"""Ranks, prefix sums and samples against plain sorting, over crowded prefixes, ties and small limits."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching, metrics, profile, rank, split
from corpusloom.operators.sides import few


def plain(rows, seed):
    """(key, id) -> rank of the hash within the key."""
    by = defaultdict(list)
    for k, i in rows:
        by[k].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return {(k, i): n for k, v in by.items() for n, (_, i) in enumerate(sorted(v), 1)}


@pytest.mark.parametrize("limit", [1, 7, 50, 100_000])
def test_rank_by_adaptive_buckets(spark, limit):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, row_id long")
    got = rank.bucketed_rank(df, ["k"], rank.hashed(3, F.col("row_id")), "row_id", "r", limit=limit)
    assert {(r.k, r.row_id): r.r for r in got.collect()} == plain(rows, 3)


def test_crowded_prefix_is_split(spark):
    # Nine rows in ten begin with the same eight digits.
    rows = [("00000fff" + hashlib.md5(str(i).encode()).hexdigest() if i % 10 else hashlib.md5(str(i).encode()).hexdigest() + "00000000", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "place string, row_id long").withColumn("v", F.col("row_id"))
    parted, totals = rank.prefix_buckets(df, [], "place", ["v"], 40)
    sizes = {r["__b"]: r["n"] for r in parted.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) <= 80 and sum(sizes.values()) == 3000
    assert {r["__b"]: r["__n"] for r in totals.collect()} == sizes
    assert len({len(b) for b in sizes}) > 1 and not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    sums = rank.bucketed_prefix_sums(df, [], F.col("place"), [F.col("place")], {"upto": F.col("v")}, 40)
    want, total = {}, 0
    for place, i in sorted(rows):
        total += i
        want[i] = total
    assert {r.row_id: r.upto for r in sums.collect()} == want


def test_equal_places_end_the_splitting(spark):
    df = spark.createDataFrame([("abcd", i) for i in range(50)], "place string, row_id long")
    got = rank.bucketed_prefix_sums(df, [], F.col("place"), [F.col("place"), F.col("row_id")], {"n": F.lit(1).cast("long")}, 5)
    assert {r.row_id: r.n for r in got.collect()} == {i: i + 1 for i in range(50)}
    assert rank.bucketed_rank(df.where("false"), [], F.col("place"), "row_id", "r").count() == 0


@pytest.mark.parametrize("parts", ["1", "5"])
def test_prefix_sums_by_ranges(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 1), float(rng.choice([0.5, 0.5, *range(300)]))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, label int, score double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.k, r.score): (r.n, r.pos, r.tp, r.seen) for r in rank.cumulative_counts(df, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for key in {r[0] for r in rows}:
        tp = seen = 0
        for s in sorted({r[2] for r in rows if r[0] == key}, reverse=True):
            here = [r[1] for r in rows if r[0] == key and r[2] == s]
            tp, seen = tp + sum(here), seen + len(here)
            want[key, s] = (len(here), sum(here), tp, seen)
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 60, 499, 500, 501])
@pytest.mark.parametrize("limit", [3, 100_000])
def test_sample(spark, n, limit):
    df = spark.range(500).select(F.col("id").alias("row_id"))
    ranks = plain([(None, i) for i in range(500)], 5)
    got = sorted(r.row_id for r in rank.sample_n(df, "row_id", n, 5, limit).collect())
    assert got == sorted(i for (_, i), r in ranks.items() if r <= n)


def test_sample_moves_few_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), rank.hashed(9, F.col("id")).alias("place"))
    last = rank.place_of_nth(rows, "place", 50, 20)
    assert 50 <= rows.where(F.substring("place", 1, len(last)) <= last).count() <= 70
    assert rank.place_of_nth(rows.limit(0), "place", 5) is None
    plan = rank.sample_n(rows.select("row_id"), "row_id", 50, 9, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" in plan  # rows behind the n-th are filtered before the window


def test_batches_by_length_of_one_length(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(1), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(64).cast("int")).alias("ids"))
    monkeypatch.setattr(batching, "BUCKET_IDS", 30 * 64)
    got = batching.assemble_batches(df, "row_id", "ids", 8, 64, by_length=True).select("batch_id", "row_id", F.size("input_ids").alias("n")).collect()
    assert len(got) == 400 and {r.batch_id for r in got} == set(range(50))
    width = {r.batch_id: r.n for r in got}
    assert [width[i] for i in range(50)] == sorted(width.values(), reverse=True) and list(width.values()).count(64) == 45


def test_small_sides_are_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("string").alias("exp_id"), (F.col("id") % 5).alias("fold"), F.rand(1).alias("score"), F.col("id").alias("row_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (
            metrics.attach_class_weight(df, metrics.class_weights(df, "label"), "label"),
            metrics.minmax_scores(df),
            split.stratified_holdout(df, "row_id", "label"),
            profile.length_histogram(df, "label", F.col("row_id")),
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few(df, 3) is df and few(df.where("false")).count() == 0
