"""Objects in any file system that Spark knows, by path: bytes in and out, and removal of a run's leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_file


def _at(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


def get_objects(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length and content of each object."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")


def put_object(spark: SparkSession, path: str, data: bytes) -> None:
    """Write or replace one object."""
    system, java = _at(spark, path)
    out = system.create(java, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete_objects(spark: SparkSession, *paths: str) -> int:
    """Remove objects or folders; those that aren't there are no error. Returns how many were."""
    return sum(bool(system.delete(java, True)) for system, java in (_at(spark, p) for p in paths))


def exists(spark: SparkSession, path: str) -> bool:
    system, java = _at(spark, path)
    return bool(system.exists(java))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of an object, or of all in a folder."""
    system, java = _at(spark, path)
    return int(system.getContentSummary(java).getLength())


def page_paths(pages: DataFrame, root: str) -> DataFrame:
    """pages with image_path: the stored one, else root/document/page-NNN.png."""
    return pages.withColumn("image_path", F.coalesce("image_path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("document_id").cast("string"), F.lit("/"), page_file(F.col("page_number")))))
