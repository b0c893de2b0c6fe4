"""Training records from reviewed attributes and from rectangles of an annotation tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TRAINABLE
from .evaluate import best_overlap_labels
from .labels import normalize_labels


def attribute_boxes_of(attributes: DataFrame, page_sizes: DataFrame | None = None) -> DataFrame:
    """One row a box: page_id, box_order (the attribute's id) and box_part (its box's number), label, x0..y1 in 0..1000 (page_sizes: page_id, width, height)."""
    from ..functions.geometry import attribute_boxes

    rows = attributes
    if page_sizes is None:
        rows = rows.withColumn("__w", F.lit(1000)).withColumn("__h", F.lit(1000))
    else:
        rows = rows.join(page_sizes.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h")), "page_id", "left").na.fill(1, ["__w", "__h"])
    boxes = rows.select("page_id", "id", F.col("entity_type_label").alias("label"), F.posexplode(attribute_boxes(F.col("bounding_boxes"), F.col("__w"), F.col("__h"))).alias("k", "b"))
    return boxes.select("page_id", F.col("id").alias("box_order"), F.col("k").alias("box_part"), "label", *[F.get("b", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


def training_records(tokens: DataFrame, attributes: DataFrame, documents: DataFrame, aliases: DataFrame, page_sizes: DataFrame | None = None, least: float = 0.1) -> DataFrame:
    """document_id, page_id, tokens, bboxes, labels of pages with an approved attribute that has a box."""
    approved = attributes.where(F.col("validation_status").isin(*TRAINABLE)).join(documents.select(F.col("id").alias("document_id"), "document_type"), "document_id")
    named = normalize_labels(approved, aliases, label="entity_type_label").withColumn("entity_type_label", F.col("normalized_label")).drop("normalized_label")
    boxes = attribute_boxes_of(named, page_sizes)
    pages = tokens.join(boxes.select("page_id").distinct(), "page_id", "left_semi")
    return _records(best_overlap_labels(pages, boxes, least=least))


def _records(labelled: DataFrame) -> DataFrame:
    item = F.struct("token_index", "token", F.array("x0", "y0", "x1", "y1").alias("box"), "label")
    per = labelled.groupBy("document_id", "page_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    return per.select("document_id", "page_id", *[F.transform("t", lambda x: x[c]).alias(n) for c, n in (("token", "tokens"), ("box", "bboxes"), ("label", "labels"))])  # noqa: B023


def rectangle_records(tokens: DataFrame, images: DataFrame, least: float = 0.1) -> DataFrame:
    """Records of pages from annotated images (``read_rectangles``); tokens need `name` (the image) and absolute boxes ax0..ay1."""
    boxes = images.select(F.col("_name").alias("name"), F.posexplode("box").alias("box_order", "b"))
    boxes = boxes.select("name", "box_order", F.col("b._label").alias("label"), *[F.col(f"b.{f}").alias(c) for f, c in (("_xtl", "x0"), ("_ytl", "y0"), ("_xbr", "x1"), ("_ybr", "y1"))])
    placed = tokens.withColumns({f"n{c}": F.col(c) for c in ("x0", "y0", "x1", "y1")}).withColumns({c: F.col(f"a{c}").cast("double") for c in ("x0", "y0", "x1", "y1")})
    labelled = best_overlap_labels(placed, boxes, page="name", least=least)
    return _records(labelled.withColumns({c: F.col(f"n{c}") for c in ("x0", "y0", "x1", "y1")}))
