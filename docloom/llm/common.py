"""What the operators share: shared storage, row identity and Arrow plumbing.

Row identity. A document is a distinct pair (id, text). Rows that repeat both
are one document and get the same result; rows that repeat the id with another
text are documents of their own; a null id is a value like any other. The pair
is carried as (id, ``TEXT_HASH``), so that joins never multiply rows.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_HASH = "__text_hash"
_within: list[str] = []
#: Bytes of an Arrow batch between Spark and Python, so that a task's memory doesn't depend on how long texts are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limit of Arrow batches to BATCH_BYTES; a row longer than that is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    if "://" not in base and not base.startswith("file:"):  # without a scheme it is a path of the default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        base = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return base.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return "/".join([application_dir(spark), *_within[-1:], f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes to a folder of its own, which is deleted at the end: results must have been written elsewhere by then."""
    folder = f"within-{uuid.uuid4().hex}"
    _within.append(folder)
    try:
        yield
    finally:
        _within.remove(folder)
        remove(spark, f"{application_dir(spark)}/{folder}")


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what the operators of this application stored (archives too); results that were read must have been written by then."""
    remove(spark, application_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing needs any more: what was made of them has been stored itself."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that carries its classes along, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def value_of(shared: Broadcast):
    return pickle.loads(shared.value)


def sample_cut(rows: DataFrame, order: Column, n: int) -> int | None:
    """The n-th smallest value of order, a 64-bit hash (the largest if there are fewer rows, None if there are none).

    Only about 2 * n hashes are sorted: from the number of rows it is known below which value so many lie.
    """
    total = rows.count()
    if not total:
        return None
    hashes = rows.select(order.alias("o"))
    if total > 4 * n:
        hashes = hashes.where(F.col("o") <= -(2**63) + int(2**64 * (2 * n + 100) / total))
    return hashes.orderBy("o").limit(n).agg(F.max("o")).first()[0]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the id, the text (null: empty) and further columns, with the text's hash."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(TEXT_HASH), *more)


def identity(docs: DataFrame) -> str:
    """DDL of the two columns that identify a document; ids may be of any atomic type."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {TEXT_HASH} long"


def by_document(left: DataFrame, right: DataFrame, how: str = "left", keep: tuple[str, ...] = ()) -> DataFrame:
    """left joined to the columns `keep` of right on the document's identity; right has one row per document."""
    right = right.select(F.col("doc_id").alias("__id"), F.col(TEXT_HASH).alias("__th"), *keep)
    on = left["doc_id"].eqNullSafe(right["__id"]) & (left[TEXT_HASH] == right["__th"])
    return left.join(right, on, how).drop("__id", "__th")


def text_runs(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about most_bytes of text, so that Python objects stay bounded; a long text stands alone."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
