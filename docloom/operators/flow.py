"""The whole way from page tokens to staged attributes as one plan, and the evaluation of record files.

Shuffles are by page (lines, clusters) and then by document (type, continuations); tokens should be stored once
before this, as several branches read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dataset_identity, record_key, stable_id
from ..schemas import DOCUMENT_TYPES, alias_table, keyword_table
from . import cluster, evaluate, labels
from . import tokens as tok


def detect_types(tokens: DataFrame, documents: DataFrame, types: dict = DOCUMENT_TYPES) -> DataFrame:
    """documents (document_id, name) with document_type and type_confidence, from the name and the first page's text."""
    spark = tokens.sparkSession
    first = tok.page_text(tok.lines(tokens.where("page_number = 1"), ("document_id",)), ("document_id",))
    rows = documents.select("document_id", "name").join(first, "document_id", "left")
    found = labels.classify(rows, keyword_table(spark, types), name="name")
    return documents.join(found.select("document_id", "document_type", F.col("confidence").alias("type_confidence")), "document_id")


def stage_attributes(tokens: DataFrame, documents: DataFrame, predictions: DataFrame | None = None, types: dict = DOCUMENT_TYPES) -> DataFrame:
    """Staged attributes of documents, continuations merged.

    tokens: ``schemas.TOKENS`` with page_number; documents: document_id, name. With predictions (page_id, token_index, label,
    confidence) attributes are spatial clusters of normalised labels; without, labelled lines, or packed paragraphs on pages
    that have none.
    """
    spark = tokens.sparkSession
    kept = tok.kept_tokens(tokens)
    typed = kept.join(detect_types(kept, documents, types).select("document_id", "document_type"), "document_id")
    pages = typed.select("page_id", "document_id", "page_number").distinct()
    columns = ("page_id", F.col("place").alias("place"), "entity_type_label", "extracted_value", "bounding_boxes", "confidence_score", "validation_status")
    if predictions is not None:
        filled = tok.fill_gaps(typed, predictions)
        named = labels.normalize_labels(filled, alias_table(spark, types)).drop("label").withColumnRenamed("normalized_label", "label")
        found = cluster.spatial_clusters(named).withColumnRenamed("cluster_index", "place").select(*columns)
    else:
        fields = cluster.labelled_lines(typed, types=types).withColumnRenamed("field_index", "place").select(*columns)
        rest = typed.join(fields.select("page_id").distinct(), "page_id", "left_anti")
        packed = cluster.packed_paragraphs(rest).withColumnRenamed("chunk_index", "place").withColumn("bounding_boxes", F.array().cast("array<array<int>>"))
        packed = packed.withColumn("validation_status", cluster.gate(F.col("confidence_score")))
        found = fields.unionByName(packed.select(*columns))
    merged = cluster.merge_continuations(found.join(pages, "page_id"), order=("page_number", "place"))
    return merged.select(stable_id(F.col("document_id"), F.col("row_index")).alias("temp_id"), "*", F.col("extracted_value").alias("original_prediction"), F.lit("model").alias("source"), F.lit(False).alias("saved"))


def keyed_records(records: DataFrame) -> DataFrame:
    """Records (``schemas.ANNOTATED_PAGE``) with their key; of repeated keys the last stays."""
    at = F.monotonically_increasing_id()
    rows = records.withColumn("ordinal", at)
    rows = rows.withColumn("key", record_key(F.col("document_id"), F.col("page_id"), F.col("page_number"), F.col("id"), F.col("ordinal")))
    return evaluate.last_by_key(rows.select("key", "ordinal", "tokens", "bboxes", "labels", "fields"))


def _positions(rows: DataFrame) -> DataFrame:
    item = F.arrays_zip("tokens", "labels", "bboxes")
    out = rows.select("key", F.posexplode(item).alias("pos", "x"))
    return out.select("key", "pos", F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"), *[F.get("x.bboxes", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


def evaluate_records(predictions: DataFrame, truth: DataFrame, least: float = 0.5) -> dict:
    """What is known of predicted records against true ones: counts, missing keys, accuracy, box and field rates, metrics by label.

    Token and field tables stay distributed; the result is a few numbers, one entry a label and the missing keys.
    """
    from ..sources.readers import validated

    t, p = keyed_records(truth), keyed_records(predictions)
    both = t.join(p.select("key"), "key", "left_semi")
    pairs = evaluate.aligned(_positions(validated(both)), _positions(validated(p.join(t.select("key"), "key", "left_semi"))))
    scores = evaluate.token_scores(pairs, least).first().asDict()
    fields = [rows.select("key", F.explode("fields").alias("field", "value")) for rows in (t, p)]
    docs = p.select("key")
    match = evaluate.field_match(fields[0].join(docs, "key", "left_semi"), fields[1].unionByName(docs.select("key", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))).first()
    per = evaluate.precision_recall(evaluate.confusion(pairs)).collect()
    return {
        "documents": t.count(),
        "evaluated_documents": both.count(),
        "missing_predictions": [r["key"] for r in evaluate.missing_keys(t, p).collect()],
        **scores,
        "field_exact_match_rate": match["rate"],
        "per_label": {r["label"]: {k: r[k] for k in ("precision", "recall", "f1")} for r in per},
    }


def record_report(predictions: DataFrame, truth: DataFrame) -> dict:
    """Reports by label of records that both sides have: `labels` counts tokens, `entities` runs of one label."""
    from ..sources.readers import validated

    t, p = keyed_records(truth), keyed_records(predictions)
    pairs = evaluate.aligned(_positions(validated(t.join(p.select("key"), "key", "left_semi"))), _positions(validated(p.join(t.select("key"), "key", "left_semi"))))
    names = labels.vocabulary(pairs.select(F.col("t_label").alias("label")), pairs.select(F.col("p_label").alias("label")))
    reports = {"labels": evaluate.classification_report(pairs, names, "t_label", "p_label"), "entities": evaluate.entity_report(pairs, "t_key", "t_pos", "t_label", "p_label", None)}
    return {name: {r["label"]: {c: r[c] for c in ("precision", "recall", "f1", "support")} for r in rows.collect()} for name, rows in reports.items()}


def predicted_records(spark: SparkSession, folder: str, engine: Callable | None = None, predictor: Callable | None = None, decoders: dict | None = None) -> DataFrame:
    """A record (``schemas.ANNOTATED_PAGE``) for each page of each image under folder, tokens with boxes in 0..1000, labels and confidences.

    engine and predictor are factories as in ``sources.boundary``. Without an engine tokens are a page's dark regions; without a
    predictor their label is OCR with confidence 0. A page without tokens gives a record with empty arrays; no image is an error.
    """
    from ..functions.geometry import normalized
    from ..sources import boundary, pages, readers

    root = readers.absolute(spark, folder)
    files = readers.read_images(spark, folder, "*.{" + ",".join(x[1:] for x in (".png", ".tif", ".tiff", *(decoders or {}))) + "}")
    if files.isEmpty():
        raise ValueError(f"no images in {folder}")
    images = pages.page_images(files, decoders).select("*", F.xxhash64("path", "page_number").alias("page_id"))
    found = boundary.extract_tokens(images.select(F.col("path").alias("document"), "page_number", "content"), engine or boundary.region_engine())
    size = images.select(F.col("path").alias("document"), "page_number", "page_id", "width", "height")
    placed = size.join(found, ["document", "page_number"], "left")
    box = F.array(*[F.coalesce(x, F.lit(0)).cast("int") for x in normalized([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("width"), F.col("height"))])
    item = F.struct("token_index", "token", box.alias("box"))
    per = placed.groupBy("document", "page_number", "page_id").agg(F.array_sort(F.collect_list(F.when(F.col("token_index").isNotNull(), item))).alias("t"))
    rows = per.select("*", F.lit(0).alias("chunk_start"), F.lit(None).cast("string").alias("document_type"), *[F.transform("t", lambda x: x[c]).alias(n) for c, n in (("token", "tokens"), ("box", "bboxes"))])  # noqa: B023
    if predictor is None:
        labelled = rows.select("*", F.transform("tokens", lambda _: F.lit("OCR")).alias("labels"), F.transform("tokens", lambda _: F.lit(0.0)).alias("confidences"))
    else:
        out = F.array_sort(F.collect_list(F.struct("local_index", "label", "confidence")))
        answers = boundary.predict_pages(rows, predictor).groupBy("page_id").agg(out.alias("p"))
        p = F.coalesce("p", F.array().cast("array<struct<local_index:int,label:string,confidence:double>>"))
        labelled = rows.join(answers, "page_id", "left").select(*rows.columns, F.transform(p, lambda x: x["label"]).alias("labels"), F.transform(p, lambda x: x["confidence"]).alias("confidences"))
    relative = F.replace(F.col("document"), F.lit(root + "/"), F.lit(""))
    document, number = dataset_identity(relative)
    return labelled.select(F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", "").alias("id"), document.alias("document_id"), F.when(F.col("page_number") > 1, F.col("page_number")).otherwise(number).alias("page_id"),
                           F.col("document").alias("image"), "tokens", "bboxes", "labels", "confidences", "document_type")
