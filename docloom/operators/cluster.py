"""From labelled tokens to attributes: spatial clusters, packed paragraphs, labelled lines and continuations over pages.

Clusters and packing are folds along sorted rows (``folds``): what is remembered is
one cluster or text. Labelled lines are windows. Continuations are `aggregate()`
over a document's attributes. The only shuffles are by page and then by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stripped, stripped_word
from ..schemas import DOCUMENT_TYPES, line_label_map
from .folds import fold_blocks, joined, starts_of
from .tokens import let

# Gaps allowed within a cluster, in widths and heights of its boxes; overlap that makes one line; length of a packed text; confidence that needs no review.
LINE_GAP, BLOCK_GAP, LEFT_SHIFT, LINE_OVERLAP, PACKED, APPROVED_FROM = 1.5, 1.75, 2.0, 0.25, 600, 0.75


def gate(confidence: Column, threshold: float = APPROVED_FROM) -> Column:
    return F.when(confidence >= threshold, "APPROVED").otherwise("HITL")


#: Columns of a cluster's token from its block on, in reading order.
_ORDER = ["block_num", "paragraph_num", "line_num", "y0", "x0", "token_index", "x1", "y1", "token", "confidence"]


def joins_cluster(first: tuple, last: tuple, row: tuple) -> bool:
    """Whether a token (values of _ORDER) goes on a cluster: places of the cluster's last token, block, paragraph and line of its first. 0 is unknown and fits all."""
    width = max(last[6] - last[4], row[6] - row[4], 0)
    high, tall = max(last[7] - last[3], 0), max(row[7] - row[3], 0)
    block = first[0] == row[0] or not first[0] or not row[0]
    if first[2] and row[2]:
        line = first[2] == row[2]
    else:
        shared = min(last[7], row[7]) - max(last[3], row[3])
        line = shared > 0 and shared >= LINE_OVERLAP * max(min(high, tall), 1)
    if line and block and (first[1] == row[1] or not first[1] or not row[1]):
        return row[4] - last[6] <= LINE_GAP * width
    down = row[3] - last[7]
    return block and 0 <= down <= BLOCK_GAP * max(high, tall) and abs(row[4] - last[4]) <= LEFT_SHIFT * width


def _breaks(block: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Whether a token of a sorted block (columns of _ORDER; `first`: it is its label's first) begins a cluster: ``joins_cluster`` for whole columns.

    A cluster takes by the gap on the line where it began, below that by the drop alone, which lines being sorted it never leaves again. So for
    each token only this matters: has its cluster left its first line, that is, did a line begin by a drop and every token since join by one.
    """
    n = block.num_rows
    at = np.arange(n)
    x0, y0, x1, y1 = (block.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
    x0, y0, x1, y1 = (v.astype(np.int64 if v.dtype.kind in "iu" else np.float64) for v in (x0, y0, x1, y1))
    places = [block.column(c).to_numpy(zero_copy_only=False) for c in ("block_num", "paragraph_num", "line_num")]
    same = [np.concatenate([[False], p[1:] == p[:-1]]) & ~first for p in places]
    before = np.maximum(at - 1, 0)
    width = np.maximum(np.maximum((x1 - x0)[before], x1 - x0), 0)
    tall = np.maximum(np.maximum((y1 - y0)[before], y1 - y0), 0)
    down = y0 - y1[before]
    gap = x0 - x1[before] <= LINE_GAP * width
    drop = same[0] & (down >= 0) & (down <= BLOCK_GAP * tall) & (np.abs(x0 - x0[before]) <= LEFT_SHIFT * width)
    line = same[0] & same[1] & same[2]
    entered = np.maximum.accumulate(np.where(~line, at, -1))
    refused = np.maximum.accumulate(np.where(~drop, at, -1))
    below = np.concatenate([[False], (entered > refused)[:-1]])  # of the token before
    out = first | np.where(line & ~below, ~gap, ~drop)

    unknown = np.logical_or.reduce([p == 0 for p in places])
    if unknown.any():  # a place that is 0 fits all, so these labels go token by token
        group = np.cumsum(first) - 1
        mine = np.flatnonzero(np.isin(group, group[unknown]))
        rows = zip(*(block.column(c).take(pa.array(mine)).to_pylist() for c in _ORDER[:8]), strict=True)
        start = last = None
        for k, row in zip(mine, rows, strict=True):
            out[k] = first[k] or not joins_cluster(start, last, row)
            start, last = row if out[k] else start, row
    return out


def _clusters():
    def step(block: pa.RecordBatch, last: bool) -> tuple[list, int]:
        """Of tokens sorted by page and label: keys, place of the first token, least index, text, boxes and mean confidence of each cluster."""
        begins = _breaks(block, starts_of(block, block.schema.names[:2]))
        starts = np.flatnonzero(begins)
        end = block.num_rows if last else int(starts[-1])
        starts, block, begins = starts[starts < end], block.slice(0, end), begins[:end]
        if not end:
            return [pa.array([], f.type) for f in block.schema][:2] + [pa.array([], block.schema.field(c).type) for c in (*_ORDER[:6], "token_index")] + [pa.array([], t) for t in (pa.string(), pa.list_(pa.list_(block.schema.field("x0").type)), pa.float64())], 0
        offsets = np.append(starts, end)
        paragraph, line = (np.concatenate([[False], v[1:] != v[:-1]]) for v in (block.column(c).to_numpy(zero_copy_only=False) for c in ("paragraph_num", "line_num")))
        signs = pa.array(["", "\n\n", "\n", " "]).take(pa.array(np.where(begins, 0, np.where(paragraph, 1, np.where(line, 2, 3)))))
        text = joined(pc.binary_join_element_wise(signs, block.column("token"), ""), offsets, "")
        sides = np.stack([block.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)
        boxes = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * end + 1, 4), pa.int32()), pa.array(sides.ravel()))
        boxes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), boxes)
        seen = np.minimum.reduceat(block.column("token_index").to_numpy(zero_copy_only=False), starts)
        total = np.bincount(np.cumsum(begins) - 1, weights=block.column("confidence").to_numpy(zero_copy_only=False))
        heads = block.take(pa.array(starts))
        return [heads.column(k) for k in (*block.schema.names[:2], *_ORDER[:6])] + [pa.array(seen), text, boxes, pa.array(total / np.diff(offsets))], end

    return step


def joined_text(run: Column) -> Column:
    """Tokens joined by a blank line where the paragraph changes, a line feed where the line does, else a space."""
    def parts(tokens: Column) -> Column:
        def part(t: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(tokens, k - 1))
            sign = F.when(k == 0, "").when(before["paragraph_num"] != t["paragraph_num"], "\n\n").when(before["line_num"] != t["line_num"], "\n").otherwise(" ")
            return F.concat(sign, t["token"])

        return F.array_join(F.transform(tokens, part), "")

    return stripped(let(run, parts))


def spatial_clusters(predictions: DataFrame, page: str = "page_id", threshold: float = APPROVED_FROM, dealt: bool = False) -> DataFrame:
    """page, cluster_index, entity_type_label, extracted_value, bounding_boxes, confidence_score, validation_status.

    predictions: page, token_index, token, label, confidence, x0..y1, block_num, paragraph_num, line_num. Tokens or labels without text, and tokens
    without a whole box, are left out; a null confidence counts as 0. Clusters of a page are in reading order, those that begin alike in the order in
    which their labels are first seen. dealt: a page's tokens share a partition already.
    """
    rows = predictions.select(page, "label", *_ORDER).na.drop(subset=["x0", "y0", "x1", "y1", "label", "token"])
    rows = rows if dealt else rows.repartition(page)
    rows = rows.withColumns({c: stripped_word(F.col(c)) for c in ("label", "token")} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("block_num", "paragraph_num", "line_num", "confidence")}).where("label <> '' AND token <> ''")
    place = ["block_num", "paragraph_num", "line_num", "y0", "x0"]
    kinds = dict(rows.dtypes)
    results = ", ".join(f"{c} {kinds[c]}" for c in (*place, "token_index")) + f", seen {kinds['token_index']}, extracted_value string, bounding_boxes array<array<{kinds['x0']}>>, confidence_score double"
    runs = fold_blocks(rows, [page, "label"], _ORDER, _clusters, results, dealt=True).repartition(page)
    runs = runs.withColumn("seen", F.min("seen").over(W.partitionBy(page, "label")))
    index = F.row_number().over(W.partitionBy(page).orderBy(*place, "seen", "token_index"))
    out = runs.select(page, index.alias("cluster_index"), F.col("label").alias("entity_type_label"), "extracted_value", "bounding_boxes", "confidence_score")
    return out.withColumn("validation_status", gate(F.col("confidence_score"), threshold))


def _packs(most: int):
    def packs():
        """Of tokens sorted by paragraph: keys, the paragraph's least index, number, text, tokens and summed confidence of each text."""
        carried = None  # the open text's paragraph and number, where it isn't its paragraph's first

        def step(block: pa.RecordBatch, last: bool) -> tuple[list, int]:
            nonlocal carried
            keys, n = block.schema.names[:3], block.num_rows
            paragraphs = np.append(np.flatnonzero(starts_of(block, keys)), n)
            ends = np.concatenate([[0], np.cumsum(pc.utf8_length(block.column("token")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
            index = block.column("token_index")
            starts, numbers, seen = [], [], []
            for s, e in zip(paragraphs[:-1], paragraphs[1:], strict=True):
                first, k = carried if carried is not None and s == 0 else (index[s].as_py(), 0)
                while s < e:
                    starts.append(s)
                    numbers.append(k)
                    seen.append(first)
                    s = min(e, max(s + 1, np.searchsorted(ends, ends[s] + most + 1, "right") - 1))
                    k += 1
            if not last:
                n = starts.pop()
                carried = seen.pop(), numbers.pop()
            starts, offsets = np.array(starts, np.int64), np.array([*starts, n], np.int32)
            text = joined(block.column("token"), offsets, " ")
            place = np.repeat(np.arange(len(starts)), np.diff(offsets))
            total = np.bincount(place, weights=block.column("conf_pct").to_numpy(zero_copy_only=False)[:n], minlength=len(starts))
            heads = block.take(pa.array(starts))
            return [heads.column(k) for k in keys] + [pa.array(seen, index.type), pa.array(numbers, pa.int32()), text, pa.array(np.diff(offsets), pa.int32()), pa.array(total)], int(n)

        return step

    return packs


def packed_paragraphs(tokens: DataFrame, page: str = "page_id", most: int = PACKED, dealt: bool = False) -> DataFrame:
    """page, chunk_index, entity_type_label, extracted_value, n_tokens, confidence_score: paragraphs packed into texts of up to `most` characters.

    A longer token stands alone; paragraphs come in the order first seen; labels are numbered where a page has several texts; a null confidence counts as 0.
    dealt: a page's tokens share a partition already.
    """
    paragraph = [page, "block_num", "paragraph_num"]
    rows = tokens.select(page, *[F.coalesce(c, F.lit(0)).alias(c) for c in paragraph[1:]], "token_index", "token", F.coalesce(F.col("conf_pct").cast("double"), F.lit(0.0)).alias("conf_pct"))
    rows = rows.na.drop(subset=["token"])
    rows = (rows if dealt else rows.repartition(*paragraph)).withColumn("token", stripped_word(F.col("token"))).where("token <> ''")
    results = f"seen {dict(rows.dtypes)['token_index']}, k int, extracted_value string, n_tokens int, total double"
    runs = fold_blocks(rows, paragraph, ["token_index", "token", "conf_pct"], _packs(most), results, dealt=True)
    w = W.partitionBy(page)
    runs = runs.withColumn("chunk_index", F.row_number().over(w.orderBy("seen", "k"))).withColumn("n", F.count(F.lit(1)).over(w))
    label = F.when(F.col("n") > 1, F.concat(F.lit("ocr_text_"), F.col("chunk_index").cast("string"))).otherwise("ocr_text")
    mean = F.round(F.col("total") / F.col("n_tokens") / 100.0, 9)
    return runs.select(page, "chunk_index", label.alias("entity_type_label"), "extracted_value", "n_tokens", mean.alias("confidence_score"))


def _label_lookup(types: dict) -> Column:
    """Fixed map {type: {label: field}} as a literal."""
    return F.create_map(*[x for t, labels in line_label_map(types).items() for x in (F.lit(t), F.create_map(*[y for a, c in labels.items() for y in (F.lit(a), F.lit(c))]))])


def labelled_lines(tokens: DataFrame, page: str = "page_id", document_type: str = "document_type", types: dict = DOCUMENT_TYPES, dealt: bool = False) -> DataFrame:
    """page, field_index, entity_type_label, extracted_value, bounding_boxes, confidence_score, validation_status of pages whose lines carry labels.

    A line that begins with a known label (`Label: value` or `Label value`) opens a field; further lines go on it. In letters
    other lines close it and are gathered by paragraph as body_n, n counting all fields so far. Pages of an unknown type, or
    without any labelled line, give nothing here (see ``packed_paragraphs``).
    dealt: a page's tokens share a partition already.
    """
    kind = F.lower(F.coalesce(F.col(document_type), F.lit("")))
    lookup = _label_lookup(types)
    rows = tokens if dealt else tokens.repartition(page)  # lines, fields and their numbers all keep to it
    rows = rows.withColumn("__type", F.col(document_type)).withColumn("__known", F.try_element_at(lookup, kind)).where("__known is not null")
    rows = rows.withColumn("token", F.coalesce(stripped_word(F.col("token")), F.lit("")))
    key = [F.coalesce(c, F.lit(0)).alias(c) for c in ("block_num", "paragraph_num", "line_num")]
    token = F.struct("token_index", "token", F.array("x0", "y0", "x1", "y1").alias("box"), (F.coalesce("conf_pct", F.lit(0.0)) / 100.0).alias("conf"))
    lines = rows.groupBy(page, "__type", *key).agg(F.array_sort(F.collect_list(token)).alias("t"), F.first("__known").alias("known"))
    lines = lines.withColumn("text", stripped(F.array_join(F.transform("t", lambda x: x["token"]), " "))).where("text <> ''")
    colon, space = F.instr("text", ":"), F.instr("text", " ")
    at_colon = F.try_element_at("known", F.lower(stripped(F.when(colon > 0, F.substring("text", F.lit(1), colon - 1)).otherwise(F.col("text")))))
    at_space = F.try_element_at("known", F.lower(stripped(F.when(space > 0, F.substring("text", F.lit(1), space - 1)).otherwise(F.col("text")))))
    after_colon = F.when(colon > 0, F.substr("text", colon + 1)).otherwise("")
    after_space = F.when(space > 0, stripped(F.substr("text", space + 1))).otherwise("")
    value = F.when(at_colon.isNotNull(), after_colon).when(at_space.isNotNull(), after_space).otherwise(after_colon)
    lines = lines.withColumn("field", F.coalesce(at_colon, at_space)).withColumn("value", value)
    opens = F.col("field").isNotNull() & ((at_colon.isNotNull() & (colon > 0)) | (stripped(F.col("value")) != ""))
    words = F.size(F.filter(F.split("value", r"(?U)\s+"), lambda w: w != ""))
    own = F.when((words > 0) & (F.size("t") >= words), F.slice("t", F.size("t") - words + 1, words)).otherwise(F.col("t"))
    lines = lines.withColumn("opens", opens).withColumn("own", F.when(F.col("opens"), own).otherwise(F.col("t"))).withColumn("para", F.concat_ws(":", "block_num", "paragraph_num"))
    lines = lines.select(page, "__type", "block_num", "paragraph_num", "line_num", "field", "opens", "para", F.when(F.col("opens"), stripped(F.col("value"))).otherwise(F.col("text")).alias("part"),
                         F.transform("own", lambda x: x["box"]).alias("boxes"), F.transform("own", lambda x: x["conf"]).alias("confs"))

    # In a letter a line without label goes on the body if it is of the paragraph of the last line that isn't bare (a label without value), and that was body too.
    w = W.partitionBy(page, "__type").orderBy("block_num", "paragraph_num", "line_num")
    before, now = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    letter, plain = F.col("__type") == "letter", ~F.col("opens") & F.col("field").isNull()
    lines = lines.withColumn("bare", letter & ~F.col("opens") & F.col("field").isNotNull())
    body = F.last(F.when(~F.col("bare"), F.when(F.col("opens"), "").otherwise(F.col("para"))), ignorenulls=True).over(before)
    lines = lines.withColumn("begins", F.col("opens") | (letter & plain & ~F.coalesce(body == F.col("para"), F.lit(False))))
    lines = lines.withColumn("number", F.sum(F.col("begins").cast("int")).over(now)).where((F.col("number") > 0) & ~F.col("bare"))
    label = F.when(F.col("opens"), F.col("field")).when(F.col("begins"), F.concat(F.lit("body_"), F.col("number").cast("string")))
    item = F.struct("block_num", "paragraph_num", "line_num", "part", "boxes", "confs")
    fields = lines.groupBy(page, "__type", "number").agg(F.array_sort(F.collect_list(item)).alias("c"), F.max(label).alias("label"))
    text = stripped(F.array_join(F.filter(F.transform("c", lambda x: x["part"]), lambda p: p != ""), "\n"))
    out = fields.withColumn("extracted_value", text).where("extracted_value <> ''").withColumn("confs", F.flatten(F.transform("c", lambda x: x["confs"])))
    mean = F.round(F.aggregate("confs", F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size("confs"), F.lit(1)), 9)
    out = out.select(page, F.row_number().over(W.partitionBy(page).orderBy("number")).alias("field_index"), F.col("label").alias("entity_type_label"), "extracted_value", F.flatten(F.transform("c", lambda x: x["boxes"])).alias("bounding_boxes"), mean.alias("confidence_score"))
    return out.withColumn("validation_status", gate(F.col("confidence_score")))


def merge_continuations(attributes: DataFrame, document: str = "document_id", order: tuple[str, ...] = ("page_number", "ordinal")) -> DataFrame:
    """Attributes of a document, those that go on from the page before merged into them.

    An attribute merges into the last row kept if both have the same label (not `ocr`) and its page follows that row's first
    page: the row's page isn't moved on, so of three pages in a row the third begins anew, and several of the second may merge.
    """
    fields = ["entity_type_label", "extracted_value", "page_number", "confidence_score", "validation_status", "bounding_boxes"]
    rows = attributes.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("r")))).alias("a"))
    rows = rows.select(document, F.transform("a", lambda x: x["r"]).alias("a"))

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        label = stripped(x["entity_type_label"])
        goes_on = (label != "") & (F.upper(label) != "OCR") & (label == last["entity_type_label"]) & (F.coalesce(x["page_number"], F.lit(0)) == F.coalesce(last["page_number"], F.lit(0)) + 1)
        conf = F.least(last["confidence_score"], x["confidence_score"])
        text = F.concat(F.regexp_replace(last["extracted_value"], r"(?U)\s+$", ""), F.lit("\n\n"), F.regexp_replace(x["extracted_value"], r"(?U)^\s+", ""))
        merged = last.withField("extracted_value", text).withField("confidence_score", conf).withField("validation_status", gate(conf)).withField("bounding_boxes", F.concat(last["bounding_boxes"], x["bounding_boxes"]))
        return F.when((F.size(out) > 0) & F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    return rows.select(document, F.posexplode(F.aggregate("a", F.slice("a", 1, 0), step)).alias("row_index", "r")).select(document, "row_index", "r.*")
