"""Whole-file JSON by byte ranges against Python's reader and against files read whole."""

import json
import random

import pytest
from pyspark.sql import types as T

from corpusloom.sources import corpus_files as files

SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("func", T.StringType()), T.StructField("target", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType()))]
)
TEXTS = ["plain", 'a "quoted" word', "{[", "}]}", '\\', '\\\\"', '"', '":{"', ',"', "two\nlines\t", "ü日\n本😀", "x" * 150, "", None, " ,", "{,"]


@pytest.fixture
def ranges_of(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


def layouts(rows, names, key):
    return {"columnar": {c: {key(r): r[i] for r in rows} for i, c in enumerate(names)}, "rowkeyed": {key(r): dict(zip(names, r, strict=True)) for r in rows}}


@pytest.mark.parametrize("size", [23, 211, 100_000])
@pytest.mark.parametrize("layout", ["columnar", "rowkeyed"])
def test_ranges_cut_anywhere(spark, tmp_path, ranges_of, layout, size):
    rng = random.Random(size)
    wanted = []
    for shard, (indent, ascii_) in enumerate([(None, True), (2, False), (None, False)]):
        rows = []
        for i in range(25 if size < 100 else 60):
            tags = rng.choice([None, [], [rng.choice(TEXTS) or "t", "b"]])
            rows.append((shard * 100 + i, rng.choice(TEXTS), rng.choice([0, 1, None]), tags))
        names = SCHEMA.names + ["other", 'odd "name"\\']
        text = json.dumps(layouts([(*r, "{", 5) for r in rows], names, lambda r: f'k"{r[0]}\\')[layout], indent=indent, ensure_ascii=ascii_)
        (tmp_path / f"s{shard}.json").write_text(text + "\n" * shard, encoding="utf-8")
        wanted += rows
    whole = rows_of(files.SCANS[layout](spark, str(tmp_path), SCHEMA))
    ranges_of(size)
    ranged = files.SCANS[layout](spark, str(tmp_path), SCHEMA, whole=10)
    assert rows_of(ranged) == sorted(tuple(map(repr, r)) for r in wanted) == whole
    if size < 1000:
        assert spark.read.text(str(tmp_path), lineSep='"').rdd.getNumPartitions() > 20


@pytest.mark.parametrize("layout", ["columnar", "rowkeyed"])
def test_odd_files(spark, tmp_path, layout):
    """Empty objects, absent and null values and columns, and columns in another order."""
    made = {
        "columnar": ["{}", ' { "row_id" : { } , "func": {"a": "x"} } ', '{"func":{"b":"y","z":"no row"},"row_id":{"a":1,"b":2}}', '{"row_id": {"a": 3}}', '{"row_id": {"a": null}, "target": {"a": 7}}'],
        "rowkeyed": ["{}", ' { "a" : { } , "b": {"func": "x"} } ', '{"a":{"target":1,"row_id":2}}', '{"a": null}', '{"a": {"row_id": 1, "tags": [ "p", null ]}}'],
    }[layout]
    for i, text in enumerate(made):
        (tmp_path / f"s{i}.json").write_text(text)
    whole = rows_of(files.SCANS[layout](spark, str(tmp_path), SCHEMA))
    assert rows_of(files.SCANS[layout](spark, str(tmp_path), SCHEMA, whole=0)) == whole and len(whole) == 4 + (layout == "rowkeyed")
