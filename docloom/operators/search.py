"""Search over documents and attributes, always within what an owner may see."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import matches, search_instant
from ..schemas import EXPORTABLE, SEARCHABLE


def owned(documents: DataFrame, user: str) -> DataFrame:
    """Documents of a user; one without an owner is nobody's."""
    return documents.where(F.col("owner_id") == user)


def scoped(rows: DataFrame, documents: DataFrame, user: str, key: str = "document_id") -> DataFrame:
    """Rows of documents that the user owns."""
    return rows.join(owned(documents, user).select(F.col("id").alias("__doc")), F.col(key) == F.col("__doc"), "left_semi")


def scoped_corrections(corrections: DataFrame, attributes: DataFrame, documents: DataFrame, user: str) -> DataFrame:
    visible = scoped(attributes, documents, user).select(F.col("id").alias("__attr"))
    return corrections.join(visible, F.col("attribute_id") == F.col("__attr"), "left_semi")


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def having(documents: DataFrame, attributes: DataFrame, condition: Column, flag: str = "has_match") -> DataFrame:
    """documents with a flag: one of its attributes meets the condition (an existence test that may stand under OR)."""
    ids = attributes.where(condition).select(F.col("document_id").alias("__hit")).distinct()
    return documents.join(ids, F.col("id") == F.col("__hit"), "left").withColumn(flag, F.col("__hit").isNotNull()).drop("__hit")


def _bound(value: str | datetime | None, end_of_day: bool = False) -> datetime | None:
    return search_instant(value, end_of_day) if isinstance(value, str) else value


def _page_args(page: int, page_size: int, most: int) -> None:
    if page < 1 or not 1 <= page_size <= most:
        raise ValueError(f"page must be 1 or more and page_size between 1 and {most}")


def find_documents(
    documents: DataFrame, attributes: DataFrame, user: str, q: str | None = None, document_type: str | None = None, status: str | None = None, start: str | datetime | None = None, end: str | datetime | None = None
) -> DataFrame:
    """All documents that a search finds, before paging. A given status replaces the default of SEARCHABLE ones."""
    rows = owned(documents, user)
    rows = rows.where(F.col("status") == status) if status else rows.where(F.col("status").isin(*SEARCHABLE))
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    if (low := _bound(start)) is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(low))
    if (high := _bound(end, end_of_day=True)) is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(high))
    if q:
        rows = having(rows, attributes, _any(matches(F.col("entity_type_label"), q), matches(F.col("extracted_value"), q)))
        rows = rows.where(_any(matches(F.col("name"), q), matches(F.col("format"), q), F.col("has_match"), matches(_as_text(rows, "extracted_attributes"), q))).drop("has_match")
    return rows


def _as_text(rows: DataFrame, column: str) -> Column:
    return F.col(column) if dict(rows.dtypes)[column] == "string" else F.to_json(column)


def paged(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20, most: int = 500) -> DataFrame:
    """One page in the given order (which should end with a key, so that it is the same every time)."""
    _page_args(page, page_size, most)
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def search_documents(documents: DataFrame, attributes: DataFrame, user: str, page: int = 1, page_size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(one row `total`, the page's documents), newest first."""
    rows = find_documents(documents, attributes, user, **filters)
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    return rows.agg(F.count(F.lit(1)).alias("total")), paged(rows, order, page, page_size)


def find_attributes(
    attributes: DataFrame, documents: DataFrame, corrections: DataFrame, user: str, q: str | None = None, attribute_name: str | None = None, min_conf: float | None = None, max_conf: float | None = None,
    document_type: str | None = None, corrected: bool | None = None, dedup: bool = False,
) -> DataFrame:
    """Attributes of a user's documents with document columns and `corrected`.

    corrected=True gives a row for every correction (dedup: one for every attribute), False only those without any.
    """
    docs = owned(documents, user).select(F.col("id").alias("doc_id"), F.col("name").alias("document_name"), "document_type")
    if document_type:
        docs = docs.where(F.col("document_type") == document_type)
    rows = attributes.where(F.col("validation_status").isin(*SEARCHABLE))
    if q:
        rows = rows.where(_any(matches(F.col("entity_type_label"), q), matches(F.col("extracted_value"), q)))
    if attribute_name:
        rows = rows.where(F.col("entity_type_label") == attribute_name)
    if min_conf is not None:
        rows = rows.where(F.col("confidence_score") >= min_conf)
    if max_conf is not None:
        rows = rows.where(F.col("confidence_score") <= max_conf)
    rows = rows.join(docs, rows["document_id"] == docs["doc_id"]).drop("doc_id")
    made = corrections.select(F.col("attribute_id").alias("__attr"))
    if corrected is True:
        return rows.join(made, rows["id"] == made["__attr"], "left_semi" if dedup else "inner").drop("__attr").withColumn("corrected", F.lit(True))
    if corrected is False:
        return rows.join(made, rows["id"] == made["__attr"], "left_anti").withColumn("corrected", F.lit(False))
    counts = made.distinct()
    return rows.join(counts, rows["id"] == counts["__attr"], "left").withColumn("corrected", F.col("__attr").isNotNull()).drop("__attr")


def search_attributes(attributes: DataFrame, documents: DataFrame, corrections: DataFrame, user: str, page: int = 1, page_size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(one row `total`, the page's attributes), most confident first."""
    rows = find_attributes(attributes, documents, corrections, user, **filters)
    return rows.agg(F.count(F.lit(1)).alias("total")), paged(rows, [F.col("confidence_score").desc(), F.col("id")], page, page_size)


def document_types(documents: DataFrame, user: str) -> DataFrame:
    return owned(documents, user).where("document_type is not null").select("document_type").distinct().orderBy("document_type")


def attribute_names(attributes: DataFrame, documents: DataFrame, user: str) -> DataFrame:
    return scoped(attributes, documents, user).where("entity_type_label is not null").select("entity_type_label").distinct().orderBy("entity_type_label")


def list_documents(documents: DataFrame, pages: DataFrame, attributes: DataFrame, user: str, q: str | None = None, limit: int = 50, shown: int = 6) -> DataFrame:
    """The newest documents with how many attributes they have, the first few of these, a text to search in and the time to show.

    The limit is taken before attributes are gathered, so only the listed documents' attributes are grouped.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = owned(documents, user)
    needle = (q or "").strip().lower()
    if needle:
        hit = _any(*(matches(F.col(c), needle) for c in ("entity_type_label", "extracted_value", "validation_status")))
        rows = having(rows, attributes, hit)
        own = [matches(F.col(c).cast("string"), needle) for c in ("name", "format", "document_type", "status", "page_count", "timestamp")]
        rows = rows.where(_any(*own, F.col("has_match"), matches(_as_text(rows, "extracted_attributes"), needle))).drop("has_match")
    listed = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    place = pages.select(F.col("id").alias("__page"), "page_number")
    wanted = attributes.join(listed.select(F.col("id").alias("__doc")), F.col("document_id") == F.col("__doc"), "left_semi")
    found = wanted.join(place, wanted["page_id"] == place["__page"])
    item = F.struct("page_number", "id", F.col("entity_type_label").alias("label"), F.col("extracted_value").alias("value"), "validation_status", "confidence_score")
    per = found.groupBy(F.col("document_id").alias("__doc")).agg(F.array_sort(F.collect_list(item)).alias("a"))
    joined = listed.join(per, listed["id"] == per["__doc"], "left")
    a = F.coalesce("a", F.array().cast(per.schema["a"].dataType))
    labels, values = (F.array_join(F.transform(a, lambda x: x[c]), " ") for c in ("label", "value"))  # noqa: B023
    shown_time = F.coalesce("processing_finished_at", "timestamp")
    return joined.select("id", "name", "format", "document_type", "page_count", shown_time.alias("shown_at"), "status", F.size(a).cast("bigint").alias("attribute_count"),
                         F.slice(a, 1, shown).alias("attribute_summaries"), F.concat_ws(" ", "name", "format", "document_type", "status", labels, values).alias("search_text"))


def export_rows(attributes: DataFrame, pages: DataFrame, documents: DataFrame, user: str | None = None, document_id: int | None = None) -> DataFrame:
    """Validated attributes with their document and page, ordered by page and attribute."""
    docs = owned(documents, user) if user is not None else documents
    docs = docs.select(F.col("id").alias("doc_id"), F.col("name").alias("document_name"), F.col("format").alias("document_format"))
    rows = attributes.where(F.col("validation_status").isin(*EXPORTABLE))
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    place = pages.select(F.col("id").alias("__page"), "page_number")
    rows = rows.join(place, rows["page_id"] == place["__page"]).join(docs, rows["document_id"] == docs["doc_id"])
    out = rows.select("document_id", "document_name", "document_format", "page_id", "page_number", F.col("id").alias("attribute_id"), "entity_type_label", "extracted_value", "confidence_score", "validation_status",
                      *[c for c in ("bounding_boxes", "page_spans") if c in attributes.columns])
    return out.orderBy("document_id", "page_number", "attribute_id")


def attribute_detail(attributes: DataFrame, pages: DataFrame, documents: DataFrame, user: str, attribute_id: int | None = None) -> DataFrame:
    docs = owned(documents, user).select(F.col("id").alias("doc_id"), F.col("name").alias("document_name"), "document_type")
    rows = attributes if attribute_id is None else attributes.where(F.col("id") == attribute_id)
    place = pages.select(F.col("id").alias("__page"), "page_number")
    return rows.join(docs, rows["document_id"] == docs["doc_id"]).join(place, rows["page_id"] == place["__page"]).drop("doc_id", "__page")


def document_detail(documents: DataFrame, pages: DataFrame, user: str, document_id: int | None = None) -> DataFrame:
    """Documents with their pages, by number, as an array."""
    from ..functions.text import image_url

    rows = owned(documents, user) if document_id is None else owned(documents, user).where(F.col("id") == document_id)
    page = F.struct("page_number", F.col("id").alias("page_id"), image_url(F.col("document_id"), F.col("page_number")).alias("image_url"))
    per = pages.groupBy(F.col("document_id").alias("__doc")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return rows.join(per, rows["id"] == per["__doc"], "left").drop("__doc")


def filter_text(rows: DataFrame, needle: str, columns: tuple[str, ...] = ("entity_type_label", "extracted_value", "validation_status")) -> DataFrame:
    """Plain substring filter over several columns at once."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.strip().lower())))


def favourites(documents: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    return documents.join(chosen.select(key).distinct(), key, "left_semi")


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's groups to n before the shuffle."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__place") <= n).drop("__place")
