"""Small steps on the file system that holds the tables, from the driver and without a Spark job."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    system, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """A file or a folder with all it holds; nothing if it does not exist."""
    system, place = _at(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, there whole or not at all; files are never replaced, so none is ever missing for a moment."""
    system, place = _at(spark, path)
    _, draft = _at(spark, f"{path}.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(draft, place):
        raise OSError(f"{path} could not be created")
