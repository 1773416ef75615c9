"""Token ids against plain Python."""

import random
from collections import Counter

import pytest

from corpusloom.operators.token_ids import encode_tokens, word_ids


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("size", [4, 500_000])  # the latter isn't broadcast
def test_ids_of_words(spark, size, limit):
    rng = random.Random(1)
    pool = ["a", "b", "é", "Z", "zz", "10", "rare", None]
    rows = [(i, rng.choices(pool, k=rng.randint(0, 12))) for i in range(60)] + [(100, None), (101, []), (102, [None]), (103, ["a"] * 5_000)]
    df = spark.createDataFrame(rows, "key long, words array<string>")
    counts = Counter(w for k, x in rows if k % 5 for w in x or [] if w is not None)
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:size]
    words = word_ids(df.where("key % 5 <> 0"), "words", size)
    assert {r.term: r.id for r in words.collect()} == {w: i for i, w in enumerate(top, 2)}
    got = encode_tokens(df, "key", "words", words, limit, size).collect()
    assert {r.row_id: r.ids for r in got} == {k: [top.index(w) + 2 if w in top else 1 for w in (x or [])[:limit]] for k, x in rows} and len(got) == len(rows)


def test_ids_of_nothing(spark):
    df = spark.createDataFrame([], "key long, words array<string>")
    assert encode_tokens(df, "key", "words", word_ids(df, "words")).count() == 0
    one = spark.createDataFrame([(1, ["a"])], df.schema)
    assert encode_tokens(one, "key", "words", word_ids(df, "words")).first().ids == [1]


def test_words_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "key long, words array<string>")
    plan = encode_tokens(df, "key", "words", word_ids(df, "words"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning(row_id") == 1 == plan.count("REPARTITION_BY_COL")
