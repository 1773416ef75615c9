"""Files that only one job can create, and tables that appear as a whole."""

from __future__ import annotations

from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop_path(spark, path)
    return bool(fs.exists(at))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def claim(spark: SparkSession, path: str) -> None:
    """Creates an empty file, in one step: of several jobs one gets it, the others a FileExistsError."""
    at, fs = hadoop_path(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(at.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(at.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(at, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(f"{path} is there: another job claimed this, or was killed with it") from None
        raise


def publish(df: DataFrame, path: str, partitions: list[str] = []) -> None:
    """Writes a table aside and moves it into place when it is whole: to a new path, or as new partitions of a path."""
    spark = df.sparkSession
    aside = f"{path}.part-{spark._jvm.java.util.UUID.randomUUID()}"
    try:
        df.write.partitionBy(*partitions).parquet(aside) if partitions else df.write.parquet(aside)
        _move(spark, aside, path, len(partitions))
    finally:
        remove(spark, aside)


def _move(spark: SparkSession, source: str, target: str, depth: int) -> None:
    at, fs = hadoop_path(spark, source)
    to, _ = hadoop_path(spark, target)
    if depth == 0:
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(at, to):
            raise FileExistsError(f"{target} appeared while it was written")
        return
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if status.isDirectory():
            _move(spark, f"{source}/{name}", f"{target}/{name}", depth - 1)


def claim_of(path: str, *names) -> str:
    """Where the claim of something in a table lies: beside the table."""
    return f"{path}.claims/" + "--".join(quote(str(n), safe="") for n in names)
