"""Writers. Each writes in parallel and is safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Fixed value: columns of the table export.
CSV_COLUMNS = (
    "document_id", "document_name", "document_format", "page_id", "page_number", "attribute_id", "entity_type_label", "extracted_value", "confidence_score", "validation_status", "bounding_boxes", "page_spans",
)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """JSON lines; returns how many, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def as_csv_rows(rows: DataFrame) -> DataFrame:
    """The export's columns, nested ones as JSON."""
    nested = {c for c, kind in rows.dtypes if kind.startswith(("array", "struct", "map"))}
    return rows.select(*[(F.to_json(c) if c in nested else F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> int:
    """The export as CSV; returns how many rows, counted as they are written."""
    seen = Observation()
    as_csv_rows(rows).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return seen.get["n"]


def as_json_documents(rows: DataFrame) -> DataFrame:
    """One JSON text a document: its validated attributes by page and id."""
    item = F.struct("page_number", "attribute_id", *[c for c in rows.columns if c not in ("page_number", "attribute_id", "document_id")])
    per = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("attributes"))
    return per.select("document_id", F.to_json(F.struct("document_id", "attributes")).alias("json"))


def write_run(rows: DataFrame, path: str) -> None:
    """A run's configuration or metrics: one JSON row."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_clustered(rows: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """A table in ranges of its keys (such as owner_id, document_id), sorted within each file.

    A lookup by the first key reads the few files and row groups whose least and greatest value enclose it; a key that holds
    many rows goes on over several files if further keys tell its rows apart.
    """
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
