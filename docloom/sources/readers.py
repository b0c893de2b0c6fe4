"""Readers with explicit schemas; paths are anything Spark's file systems know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dataset_identity, media_extension, stripped
from ..schemas import ANNOTATED_PAGE, CVAT, TEXT_EXAMPLE, format_table


def read_jsonl(spark: SparkSession, path: str, schema: str = ANNOTATED_PAGE) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, anything but an object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_folder(spark: SparkSession, path: str, schema: str = ANNOTATED_PAGE) -> DataFrame:
    """Records of all .json files under path, each an object or a list of objects."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def validated(records: DataFrame) -> DataFrame:
    """records, with an error for the first whose arrays are missing, of different length, or whose boxes aren't four numbers."""
    bad = F.when(F.col("tokens").isNull() | F.col("bboxes").isNull() | F.col("labels").isNull(), "tokens, bboxes and labels are needed")
    bad = bad.when((F.size("tokens") != F.size("bboxes")) | (F.size("tokens") != F.size("labels")), "tokens, bboxes and labels differ in length")
    bad = bad.when(F.exists("bboxes", lambda b: F.size(b) != 4), "a box needs four numbers")
    return records.withColumn("__bad", F.when(bad.isNotNull(), F.raise_error(bad))).where("__bad is null").drop("__bad")


def token_examples(records: DataFrame) -> DataFrame:
    """Training examples: records without tokens, labels or boxes are skipped, other lengths are an error; the id may be the image or the record id."""
    kept = records.where("size(coalesce(tokens, array())) > 0 and size(coalesce(labels, array())) > 0 and size(coalesce(bboxes, array())) > 0")
    return validated(kept).withColumn("document_id", F.coalesce("document_id", "image", "id"))


def text_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEXT_EXAMPLE).option("mode", "PERMISSIVE").json(path).dropna(subset=["text", "label"]).where(stripped(F.col("text")) != "")


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """Annotated images of an XML export: name and boxes."""
    return spark.read.format("xml").option("rowTag", "image").schema(CVAT).load(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,tif,tiff,bmp}") -> DataFrame:
    """Image files under path with the document and page their names say, and their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    document, page = dataset_identity(F.col("path"))
    return files.select("path", document.alias("document"), page.alias("page_number"), "content")


def absolute(spark: SparkSession, path: str) -> str:
    """The path with its file system, as readers report files under it."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(java).getPath().toString()


def check_uploads(uploads: DataFrame, name: str = "name", media_type: str = "media_type") -> DataFrame:
    """uploads with is_valid: an accepted extension with its media type."""
    table = F.broadcast(format_table(uploads.sparkSession).select(F.col("extension").alias("__ext"), F.col("media_type").alias("__type")))  # a fixed table
    joined = uploads.join(table, media_extension(F.col(name)) == F.col("__ext"), "left")
    return joined.withColumn("is_valid", F.coalesce(F.lower(media_type) == F.col("__type"), F.lit(False))).drop("__ext", "__type")


def read_tables(spark: SparkSession, path: str, *names: str, format: str = "parquet", **options) -> dict[str, DataFrame]:
    """Named tables of a folder (or, with format jdbc and its options, of a database)."""
    if format == "jdbc":
        return {n: spark.read.format("jdbc").options(dbtable=n, **options).load() for n in names}
    return {n: spark.read.format(format).options(**options).load(f"{path}/{n}.{format}") for n in names}
