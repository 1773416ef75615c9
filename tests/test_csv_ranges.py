"""CSV by byte ranges against Python's reader and against files read whole."""

import csv
import random

import pytest
from pyspark.sql import types as T

from corpusloom.sources import corpus_files as files
from corpusloom.sources.scratch import new_path

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("func", T.StringType()), T.StructField("target", T.IntegerType())])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 61, 100_000])
def test_records_on_the_edges_of_ranges(spark, tmp_path, end, size):
    rng = random.Random(size)
    texts = ["plain", 'a "quoted" word', "two\nlines", '"', '""\n"', "comma, and\n\n\nempty lines", "ü日\n本", "x" * 150, "tail\n", "\nhead"]
    wanted, number = [], 0
    for shard in range(3):
        rows = [(number + i, rng.choice(texts) + str(rng.randint(0, 9)) * (i % 2), i % 2) for i in range(80)]
        number += 80
        with open(tmp_path / f"s{shard}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL if shard else csv.QUOTE_ALL)
            out.writerow(["row_id", "func", "target"])
            out.writerows(rows)
        wanted += rows
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(size))
    try:
        ranged = files.scan_csv(spark, str(tmp_path), SCHEMA, whole=10)
        got = sorted(map(tuple, ranged.collect()))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert got == sorted(wanted)
    assert got == sorted(map(tuple, files.scan_csv(spark, str(tmp_path), SCHEMA).collect()))


def test_empty_and_missing_values(spark):
    path = new_path(spark, "csv")
    rows = spark.createDataFrame([(1, "", 0), (2, None, None), (3, 'a\n"q', 1)], SCHEMA)
    rows.write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="")
    for whole in (0, 1 << 30):
        got = sorted(map(tuple, files.scan_csv(spark, path, SCHEMA, whole=whole).collect()))
        assert got == sorted(map(tuple, files.scan_csv(spark, path, SCHEMA).collect())) and len(got) == 3 and got[2] == (3, 'a\n"q', 1)
    assert files.scan_csv(spark, path, SCHEMA, glob="none*", whole=0).count() == 0
