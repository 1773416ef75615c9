"""Tables and files of a job in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, as in local tests, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


_lock, _writing = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting CLEANUP while some thread writes; the last one puts it back."""
    with _lock:
        if not _writing["n"]:
            _writing["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["n"] -= 1
            if not _writing["n"]:
                spark.conf.set(CLEANUP, _writing["before"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and gives the written table. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
