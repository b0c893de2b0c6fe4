"""Review as snapshots: latest corrections over attributes, staged over saved rows, and a status machine folded over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import media_extension, stripped
from ..schemas import TRANSITIONS


def apply_corrections(attributes: DataFrame, corrections: DataFrame) -> DataFrame:
    """attributes with the value (and, where given, label and status) of the latest correction, its operator and how many there were."""
    has = set(corrections.columns)
    fields = [F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in ("corrected_value", "corrected_label", "validation_status", "operator_user")]
    last = corrections.groupBy(F.col("attribute_id").alias("__attr")).agg(F.max_by(F.struct(*fields), "id").alias("c"), F.count(F.lit(1)).alias("n"))
    joined = attributes.join(last, attributes["id"] == last["__attr"], "left")
    value = F.when(F.col("n").isNotNull(), F.col("c.corrected_value")).otherwise(F.col("extracted_value"))
    return (joined.withColumn("original_prediction", F.col("extracted_value")).withColumn("extracted_value", value)
            .withColumn("entity_type_label", F.coalesce("c.corrected_label", "entity_type_label")).withColumn("validation_status", F.coalesce("c.validation_status", "validation_status"))
            .withColumn("operator_user", F.col("c.operator_user")).withColumn("correction_count", F.coalesce("n", F.lit(0).cast("bigint"))).drop("__attr", "c", "n"))


def staged_or_saved(staged: DataFrame, saved: DataFrame, document: str = "document_id") -> DataFrame:
    """Staged rows of documents that have any, else the saved ones; review_state is draft where only staged rows exist."""
    staged_docs = staged.select(F.col(document).alias("__doc")).distinct()
    saved_docs = saved.select(F.col(document).alias("__doc")).distinct()
    only = staged.join(saved_docs, F.col(document) == F.col("__doc"), "left")
    drafts = only.withColumn("review_state", F.when(F.col("__doc").isNull(), "draft").otherwise("saved")).drop("__doc").withColumn("origin", F.lit("staged"))
    rest = saved.join(staged_docs, F.col(document) == F.col("__doc"), "left_anti").withColumn("review_state", F.lit("saved")).withColumn("origin", F.lit("saved"))
    return drafts.unionByName(rest)


def save_selected(staged: DataFrame, selected: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to save, staged rows that remain).

    A selected row is approved; a manual one keeps its own confidence, one of the model takes the staged confidence; boxes
    it doesn't bring come from the staged row. Its page is found by number; a row on no page is an error.
    """
    base = staged.select(F.col("temp_id").alias("__temp"), F.col("document_id").alias("__doc"), F.col("confidence_score").alias("__conf"), F.col("bounding_boxes").alias("__boxes"), F.col("page_number").alias("__number"))
    rows = selected.join(base, F.col("temp_id") == F.col("__temp"), "left").withColumn("document_id", F.coalesce("document_id", "__doc"))
    number = F.coalesce("page_number", "__number")
    place = pages.select(F.col("id").alias("__page"), F.col("document_id").alias("__pdoc"), F.col("page_number").alias("__pnum"))
    rows = rows.join(place, (F.col("document_id") == F.col("__pdoc")) & (number == F.col("__pnum")), "left")
    page = F.coalesce("__page", F.raise_error(F.concat(F.lit("no such page: "), F.coalesce(number.cast("string"), F.lit("null")))).cast("bigint"))
    boxes = F.when(F.size(F.coalesce("bounding_boxes", F.array().cast("array<array<double>>"))) > 0, F.col("bounding_boxes")).otherwise(F.col("__boxes"))
    conf = F.when(F.col("source") == "manual", F.col("confidence_score")).otherwise(F.coalesce("__conf", "confidence_score"))
    saved = rows.select("temp_id", "document_id", page.alias("page_id"), stripped(F.col("entity_type_label")).alias("entity_type_label"), stripped(F.col("extracted_value")).alias("extracted_value"),
                        boxes.alias("bounding_boxes"), conf.alias("confidence_score"), F.lit("APPROVED").alias("validation_status"), "source")
    return saved, staged.join(selected.select("temp_id"), "temp_id", "left_anti")


def delete_attributes(attributes: DataFrame, corrections: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes and corrections without the given attribute ids."""
    gone = ids.select(F.col("id").alias("__gone"))
    return attributes.join(gone, F.col("id") == F.col("__gone"), "left_anti"), corrections.join(gone, F.col("attribute_id") == F.col("__gone"), "left_anti")


def accepted(status: Column, target: Column, event: Column) -> Column:
    """Whether a document in `status` may go to `target` now: a known status, an edge of the graph (or no change) and what the target needs."""
    known = target.isin(*TRANSITIONS)
    edge = target == status
    for source, targets in TRANSITIONS.items():
        edge = edge | ((status == source) & target.isin(*targets))
    needs = (F.when(target == "PROCESSING", event["has_started"]).when(target == "PROCESSED", (event["page_rows"] > 0) & (event["page_rows"] == event["page_count"]) & event["has_timing"])
             .when(target == "FAILED", event["has_timing"]).when(target == "APPROVED", event["page_rows"] > 0).otherwise(True))
    return F.coalesce(known & edge & needs, F.lit(False))


def may_follow(status: str, target: str, page_rows: int | None, page_count: int | None, has_started: bool | None, has_timing: bool | None) -> bool:
    """`accepted` for plain values, where state lives outside of a plan."""
    if target not in TRANSITIONS or (target != status and target not in TRANSITIONS[status]):
        return False
    rows = page_rows or 0
    needs = {"PROCESSING": has_started, "PROCESSED": rows > 0 and rows == page_count and has_timing, "FAILED": has_timing, "APPROVED": rows > 0}
    return bool(needs.get(target, True))


def fold_status(events: DataFrame, document: str = "document_id", initial: str = "PENDING") -> DataFrame:
    """document, status, n_accepted, n_rejected after all its events in order (document, seq, target, page_rows, page_count, has_started, has_timing).

    A rejected event changes nothing; a change to the same status counts as accepted.
    """
    item = F.struct("seq", F.upper(stripped(F.col("target"))).alias("target"), "page_rows", "page_count", "has_started", "has_timing")
    rows = events.groupBy(document).agg(F.array_sort(F.collect_list(item)).alias("e"))
    start = F.struct(F.lit(initial).alias("status"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("bad"))

    def step(acc: Column, e: Column) -> Column:
        good = accepted(acc["status"], e["target"], e)
        return F.struct(F.when(good, e["target"]).otherwise(acc["status"]).alias("status"), (acc["ok"] + good.cast("int")).alias("ok"), (acc["bad"] + (~good).cast("int")).alias("bad"))

    return rows.select(document, F.aggregate("e", start, step).alias("r")).select(document, "r.status", F.col("r.ok").alias("n_accepted"), F.col("r.bad").alias("n_rejected"))


def queued_documents(uploads: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to append, uploads refused): uploads (document_id, name, media_type, owner_id, timestamp) of an accepted kind, once each, as queued.

    An upload whose document is there already is neither, so a batch that comes again appends nothing.
    """
    from ..sources.readers import check_uploads

    checked = check_uploads(uploads)
    fresh = checked.where("is_valid").dropDuplicates(["document_id"]).join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    values = {"id": F.col("document_id"), "name": F.col("name"), "format": F.substring(media_extension(F.col("name")), 2, 20), "owner_id": F.col("owner_id"), "timestamp": F.col("timestamp"), "status": F.lit("QUEUED"), "page_count": F.lit(0)}
    rows = fresh.select(*[values.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in documents.schema])
    return rows, checked.where("not is_valid").drop("is_valid")


def reprocessable(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isin("CANCELED", "FAILED"))


def replace_documents(current: DataFrame, fresh: DataFrame, document: str = "document_id") -> DataFrame:
    """A new snapshot: all rows of documents in `fresh` are replaced by its rows."""
    return current.join(fresh.select(document).distinct(), document, "left_anti").unionByName(fresh)


def orphans(documents: DataFrame, pages: DataFrame, attributes: DataFrame, corrections: DataFrame) -> DataFrame:
    """constraint and n of rows that break it: keys without their parent, attributes whose page is another document's, repeated keys."""
    docs, page_ids = documents.select(F.col("id").alias("p")), pages.select(F.col("id").alias("p"), F.col("document_id").alias("pd"))
    n = lambda name, df: df.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("n"))
    checks = [
        n("page_without_document", pages.join(docs, F.col("document_id") == F.col("p"), "left_anti")),
        n("attribute_without_document", attributes.join(docs, F.col("document_id") == F.col("p"), "left_anti")),
        n("attribute_without_page", attributes.join(page_ids, F.col("page_id") == F.col("p"), "left_anti")),
        n("attribute_page_of_other_document", attributes.join(page_ids, F.col("page_id") == F.col("p")).where("document_id <> pd")),
        n("correction_without_attribute", corrections.join(attributes.select(F.col("id").alias("p")), F.col("attribute_id") == F.col("p"), "left_anti")),
        n("repeated_page", pages.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out
