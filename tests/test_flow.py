"""The whole flow, record evaluation, the command line, storage and image arrays."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.functions import images
from docloom.operators import flow
from docloom.schemas import ANNOTATED_PAGE
from docloom.sources import storage


def page_rows(document, page, number, lines, conf=90.0):
    rows, k = [], 0
    for n, line in enumerate(lines, 1):
        for j, w in enumerate(line.split()):
            rows.append((document, page, number, k, w, 50 * j, 20 * n, 50 * j + 40, 20 * n + 12, conf, 1, 1, n))
            k += 1
    return rows


TOKENS = "document_id long, page_id long, page_number int, token_index int, token string, x0 int, y0 int, x1 int, y1 int, conf_pct double, block_num int, paragraph_num int, line_num int"


def test_tokens_to_staged_attributes(spark):
    rows = page_rows(1, 10, 1, ["Invoice number: 77", "Bill to: Acme"]) + page_rows(1, 11, 2, ["Bill to: Corp"]) + page_rows(2, 20, 1, ["plain words without a type"]) + page_rows(3, 30, 1, ["junk"], conf=26.0)
    tokens = spark.createDataFrame(rows, TOKENS)
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "c.pdf")], "document_id long, name string")
    types = {r["document_id"]: r["document_type"] for r in flow.detect_types(tokens, docs).collect()}
    assert types == {1: "invoice", 2: "unknown", 3: "unknown"}
    staged = flow.stage_attributes(tokens, docs).orderBy("document_id", "row_index").collect()
    assert [(r["document_id"], r["entity_type_label"], r["extracted_value"]) for r in staged] == [(1, "invoice_number", "77"), (1, "bill_to", "Acme\n\nCorp"), (2, "ocr_text", "plain words without a type")]
    predictions = tokens.select("page_id", "token_index", F.when(F.col("token_index") == 2, " DATE").otherwise("total").alias("label"), F.lit(0.9).alias("confidence"))
    found = flow.stage_attributes(tokens, docs, predictions).where("document_id = 1").collect()
    assert {r["entity_type_label"] for r in found} == {"invoice_date", "total_amount"} and len({r["temp_id"] for r in found}) == len(found)


def record(k, labels, tokens=("a", "b"), fields=None, boxes=((0, 0, 10, 10), (20, 0, 30, 10))):
    return {"document_id": str(k), "page_id": 1, "tokens": list(tokens), "bboxes": [list(b) for b in boxes], "labels": list(labels), "fields": fields}


def test_evaluation_of_records(spark, tmp_path, capsys):
    truth = [record(1, ["x", "O"], fields={"f": "1", "g": " 2"}), record(2, ["x", "x"]), record(3, ["O", "O"])]
    predicted = [record(1, ["O", "O"]), record(1, ["x", "y"], fields={"f": "1 "}), record(2, ["x", "x"], boxes=((0, 0, 10, 10), (90, 0, 95, 5)))]
    t, p = (spark.createDataFrame([{**x, "page_number": None, "id": None, "image": None, "confidences": None, "document_type": None} for x in rows], ANNOTATED_PAGE) for rows in (truth, predicted))
    got = flow.evaluate_records(p.coalesce(1), t)
    assert (got["documents"], got["evaluated_documents"], got["missing_predictions"], got["token_count"]) == (3, 2, ["3:1"], 4)
    assert (got["token_accuracy"], got["bbox_iou_match_rate"], got["field_exact_match_rate"]) == (0.75, 0.75, 0.5)
    assert got["per_label"]["x"] == {"precision": 1.0, "recall": 1.0, "f1": 1.0} and got["per_label"]["y"]["precision"] == 0.0
    report = flow.record_report(p.coalesce(1), t)
    assert report["entities"]["x"] == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "support": 2} and report["entities"]["y"]["support"] == 0
    assert report["entities"]["micro avg"]["precision"] == pytest.approx(2 / 3) and report["entities"]["macro avg"]["recall"] == 0.5 and report["entities"]["weighted avg"]["f1"] == 1.0
    assert report["labels"]["O"]["recall"] == 0.0 and report["labels"]["accuracy"]["f1"] == 0.75
    nothing = flow.record_report(p.limit(0), t)["entities"]
    assert set(nothing) == {"micro avg", "macro avg", "weighted avg"} and all(r == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0} for r in nothing.values())
    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "t.json").write_text(json.dumps(truth))
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, truth)))
    assert cli.main(["evaluate", str(tmp_path / "p.jsonl"), str(folder)]) == 0
    assert json.loads(capsys.readouterr().out)["token_accuracy"] == 1.0
    assert cli.main(["report", str(tmp_path / "p.jsonl"), str(folder)]) == 0
    assert json.loads(capsys.readouterr().out)["entities"]["micro avg"]["f1"] == 1.0
    assert cli.main(["convert", str(folder), str(tmp_path / "out")]) == 0 and json.loads(capsys.readouterr().out) == {"records": 3}
    assert cli.main(["split", str(tmp_path / "p.jsonl"), str(tmp_path / "split"), "--seed", "1"]) == 0
    assert {r["split"] for r in spark.read.json(str(tmp_path / "split")).collect()} <= {"train", "val", "test"}


def test_storage(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.bin"
    storage.put_object(spark, path, b"one")
    storage.put_object(spark, path, b"two!")
    assert storage.exists(spark, path) and bytes(storage.get_objects(spark, path).first()["content"]) == b"two!"
    assert storage.delete_objects(spark, path, path) == 1 and not storage.exists(spark, path)
    pages = spark.createDataFrame([(1, 3, None), (1, 4, "kept.png")], "document_id long, page_number int, image_path string")
    assert [r["image_path"] for r in storage.page_paths(pages, "root/").collect()] == ["root/1/page-003.png", "kept.png"]


def page_image():
    image = np.full((200, 300), 255, np.uint8)
    for y in range(40, 160, 20):
        image[y : y + 5, 40:260] = 0
    return image


def test_images():
    image = page_image()
    assert images.gray(np.stack([image] * 3, axis=2)).tolist() == image.tolist()
    assert abs(images.skew(images.turned(image, 15.0)) - 15.0) <= 1.5
    straight, angle = images.deskewed(images.turned(image, -7.0))
    assert abs(angle + 7.0) <= 1.5 and abs(images.skew(straight)) <= 1.0
    assert len(images.components(image)) == 6 and images.components(image)[0] == (40, 40, 260, 45)
    assert images.fallback_tokens(image)[0]["conf_pct"] == 0.0 and images.components(np.full((9, 9), 255, np.uint8)) == []
    flat = np.full((64, 64), 100, np.uint8)
    assert images.threshold(flat).min() == 255 and images.median(flat).tolist() == flat.tolist() and images.equalized(flat).shape == flat.shape
    assert set(np.unique(images.prepared(image))) <= {0, 255}
    with pytest.raises(ValueError):
        images.gray(np.zeros((0, 0), np.uint8))
