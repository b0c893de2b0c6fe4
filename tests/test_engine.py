"""Geometry, labels, search, review, evaluation, splits, readers, writers and streams on small rows."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import geometry, text
from docloom.operators import evaluate, export, labels, review, search, split
from docloom.sources import boundary, readers, writers
from docloom.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def box(*values):
    return [F.lit(v) for v in values]


# --- geometry


def test_boxes(spark):
    assert list(one(spark, *geometry.normalized(box(20, 10, 40, 30), F.lit(400), F.lit(200)))) == [50, 50, 100, 150]
    assert list(one(spark, *geometry.normalized(box(1, 3, 5, 7), F.lit(2000), F.lit(2000)))) == [0, 2, 2, 4]  # halves go to even
    with pytest.raises(Exception, match="positive"):
        one(spark, *geometry.normalized(box(1, 1, 2, 2), F.lit(0), F.lit(5)))
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), geometry.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)))[0] == pytest.approx(1 / 3)
    assert one(spark, geometry.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)))[0] == 0.0


def test_attribute_boxes(spark):
    df = spark.createDataFrame([([[100.0, 200.0, 300.0, 400.0], [1.0, 2.0, 3.0], [float("nan"), 1.0, 2.0, 3.0], [10.0, 20.0, 30.0, None], [0.1, 0.2, 0.5, 1.0], [500.0, 600.0, 1500.0, 1200.0]],)], "b array<array<double>>")
    got = df.select(geometry.attribute_boxes(F.col("b"), F.lit(1000), F.lit(2000)).alias("b")).first()["b"]
    assert got == [[100, 200, 300, 400], [100, 200, 500, 1000], [500, 300, 1000, 600]]


def test_affine_maps(spark):
    turn = geometry.orientation(F.lit(90), F.lit(100), F.lit(60))
    there = geometry.affine_box(box(10.0, 20.0, 30.0, 40.0), turn, F.lit(60), F.lit(100))
    back = geometry.affine_box([x.cast("double") for x in there], geometry.inverse_affine(turn), F.lit(100), F.lit(60))
    assert list(one(spark, *back)) == [10, 20, 30, 40]
    shift = [F.lit(x) for x in (1.0, 0.0, 7.0, 0.0, 1.0, -4.0)]
    assert list(one(spark, *geometry.affine_box(box(27.0, 6.0, 47.0, 26.0), geometry.inverse_affine(shift), F.lit(100), F.lit(60)))) == [20, 10, 40, 30]
    assert list(one(spark, *geometry.compose_affine(shift, shift))) == [1.0, 0.0, 14.0, 0.0, 1.0, -8.0]


# --- strings


def test_strings(spark):
    document, page = text.dataset_identity(F.col("p"))
    df = spark.createDataFrame([("invoice-001/page-002.png",), ("a\\b\\Page-7.tif",), ("scan.v2.png",), ("page-3.png",), ("dir/other.jpg",)], "p string").select(document.alias("d"), page.alias("n"))
    assert [tuple(r) for r in df.collect()] == [("invoice-001", 2), ("a/b", 7), ("scan.v2", 1), ("page-3", 1), ("dir/other", 1)]
    assert one(spark, text.matches(F.lit("50% off\\now"), "% OFF\\n"), text.matches(F.lit("abc"), "a_c"))[:] == (True, True)
    assert text.search_instant("2026-09-05", end_of_day=True) == datetime(2026, 9, 5, 23, 59, 59, 999999)
    assert text.search_instant("2026-09-05") == datetime(2026, 9, 5)
    with pytest.raises(ValueError):
        text.search_instant("yesterday")
    assert tuple(one(spark, *text.before_after(F.lit("a:b:c"), ":"))) == ("a", True, "b:c")
    assert one(spark, text.page_file(F.lit(7)))[0] == "page-007.png"


# --- labels and types


def test_types_and_aliases(spark):
    docs = spark.createDataFrame([(1, "Invoice number 7, amount due", ""), (2, "Dear Ann, sincerely", ""), (3, "nothing", "x.pdf"), (4, "information", "")], "document_id long, text string, name string")
    got = {r["document_id"]: r for r in labels.classify(docs, schemas.keyword_table(spark), name="name").collect()}
    assert [got[k]["document_type"] for k in (1, 2, 3, 4)] == ["invoice", "letter", "unknown", "form"]
    assert got[1]["best_score"] == 5 and got[3]["confidence"] == 0.0
    rows = spark.createDataFrame([("invoice", "DATE"), ("Student_ID", " NAME "), (None, "RAW_LABEL"), ("invoice", " ")], "document_type string, label string")
    assert [r["normalized_label"] for r in labels.normalize_labels(rows, schemas.alias_table(spark)).collect()] == ["invoice_date", "student_name", "raw_label", " "]
    vocabulary = labels.vocabulary(spark.createDataFrame([("beta",), ("alpha",), ("beta",), (None,), ("",)], "label string"))
    assert [(r["label"], r["label_id"]) for r in vocabulary.orderBy("label_id").collect()] == [("alpha", 0), ("beta", 1)]
    heads = {r["document_type"]: r["labels"] for r in labels.head_labels(schemas.field_table(spark)).collect()}
    assert heads["form"] == ["other", "applicant_name", "date", "signature"]


# --- search


@pytest.fixture
def store(spark):
    day = lambda d: datetime(2026, 9, d)
    docs = spark.createDataFrame(
        [(1, "a.pdf", "pdf", "ann", "invoice", 1, day(5), None, "PROCESSED", '[{"v": "111.11"}]'), (2, "b.pdf", "pdf", "ann", "letter", 1, day(6), day(7), "APPROVED", "[]"), (3, "c.pdf", "pdf", "bob", "invoice", 1, day(7), None, "PROCESSED", "[]"),
         (4, "d.pdf", "pdf", None, "invoice", 1, day(8), None, "PROCESSED", "[]"), (5, "e.pdf", "pdf", "ann", "form", 1, datetime(2026, 9, 5, 23, 59, 59), None, "QUEUED", "[]")],
        "id long, name string, format string, owner_id string, document_type string, page_count int, timestamp timestamp, processing_finished_at timestamp, status string, extracted_attributes string")
    pages = spark.createDataFrame([(10, 1, 1), (20, 2, 1), (30, 3, 1)], "id long, document_id long, page_number int")
    attributes = spark.createDataFrame([(100, 10, 1, "total", "9.50", 0.9, "APPROVED"), (101, 10, 1, "name", "Acme", 0.5, "PENDING"), (102, 20, 2, "to", "Zed_x", 0.7, "PROCESSED"), (103, 30, 3, "total", "1", 0.9, "APPROVED")],
                                       "id long, page_id long, document_id long, entity_type_label string, extracted_value string, confidence_score double, validation_status string")
    corrections = spark.createDataFrame([(1, 100, "9", "9.50", "ann"), (2, 100, "9.5", "9.55", "bob")], "id long, attribute_id long, original_prediction string, corrected_value string, operator_user string")
    return docs, pages, attributes, corrections


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search(store):
    docs, pages, attributes, corrections = store
    find = lambda user="ann", **x: ids(search.find_documents(docs, attributes, user, **x))
    assert find() == [1, 2] and find("bob") == [3] and find(status="QUEUED") == [5]
    assert find(q="111.11") == [1] and find(q="ACME") == [1] and find(q="zed_x") == [2] and find(q="nothing") == []
    assert find(status="QUEUED", end="2026-09-05") == [5] and find(start="2026-09-06") == [2] and find(document_type="letter") == [2]
    attr = lambda **x: [r["id"] for r in search.find_attributes(attributes, docs, corrections, "ann", **x).collect()]
    assert sorted(attr()) == [100, 102] and attr(corrected=True) == [100, 100] and attr(corrected=True, dedup=True) == [100] and attr(corrected=False) == [102]
    assert attr(min_conf=0.7, max_conf=0.8) == [102] and attr(attribute_name="total") == [100]
    total, page = search.search_attributes(attributes, docs, corrections, "ann", page=2, page_size=1)
    assert total.first()["total"] == 2 and ids(page) == [102]
    with pytest.raises(ValueError):
        search.search_documents(docs, attributes, "ann", page_size=501)
    listed = search.list_documents(docs, pages, attributes, "ann").collect()
    assert [r["id"] for r in listed] == [2, 5, 1] and listed[2]["attribute_count"] == 2 and listed[0]["shown_at"] == datetime(2026, 9, 7)


# --- review


def test_review(spark, store):
    docs, pages, attributes, corrections = store
    fixed = {r["id"]: r for r in review.apply_corrections(attributes, corrections).collect()}
    assert (fixed[100]["extracted_value"], fixed[100]["correction_count"], fixed[100]["operator_user"]) == ("9.55", 2, "bob") and fixed[102]["correction_count"] == 0
    left, logs = review.delete_attributes(attributes, corrections, spark.createDataFrame([(100,)], "id long"))
    assert ids(left) == [101, 102, 103] and logs.count() == 0
    bad = {r["constraint"]: r["n"] for r in review.orphans(docs, pages, attributes.withColumn("page_id", F.when(F.col("id") == 103, 10).otherwise(F.col("page_id"))), corrections).collect()}
    assert bad["attribute_page_of_other_document"] == 1 and sum(bad.values()) == 1


@pytest.mark.parametrize(
    ("targets", "status"),
    [(["QUEUED"], "QUEUED"), (["nope"], "PENDING"), (["PROCESSED"], "PENDING"), (["QUEUED", "canceled"], "CANCELED"), (["QUEUED", "PROCESSING", "PROCESSED", "APPROVED"], "APPROVED"), (["QUEUED", "PROCESSING", "FAILED", "QUEUED"], "QUEUED")],
)
def test_status_graph(spark, targets, status):
    rows = [(1, k, t, 1, 1, True, True) for k, t in enumerate(targets)]
    assert review.fold_status(spark.createDataFrame(rows, ingest.STATUS_EVENT)).first()["status"] == status


def test_status_prerequisites(spark):
    rows = [(1, 0, "QUEUED", 0, 1, False, False), (1, 1, "PROCESSING", 0, 1, False, False), (2, 0, "QUEUED", 0, 2, True, True), (2, 1, "PROCESSING", 1, 2, True, True), (2, 2, "PROCESSED", 1, 2, True, True)]
    got = {r["document_id"]: (r["status"], r["n_rejected"]) for r in review.fold_status(spark.createDataFrame(rows, ingest.STATUS_EVENT)).collect()}
    assert got == {1: ("QUEUED", 1), 2: ("PROCESSING", 1)}


def test_save_selected(spark):
    staged = spark.createDataFrame([("m1", 1, 0.6, [[1.0, 2.0, 3.0, 4.0]], 1), ("m2", 1, 0.7, [[1.0, 1.0, 1.0, 1.0]], 1)], "temp_id string, document_id long, confidence_score double, bounding_boxes array<array<double>>, page_number int")
    chosen = spark.createDataFrame([("m1", 1, None, "total ", " 5", None, 0.1, "model"), ("n1", 1, 1, "x", "y", [[0.0, 0.0, 1.0, 1.0]], 1.0, "manual")], "temp_id string, document_id long, page_number int, entity_type_label string, extracted_value string, bounding_boxes array<array<double>>, confidence_score double, source string")
    pages = spark.createDataFrame([(7, 1, 1)], "id long, document_id long, page_number int")
    saved, rest = review.save_selected(staged, chosen, pages)
    got = {r["temp_id"]: r for r in saved.collect()}
    assert got["m1"]["confidence_score"] == 0.6 and got["m1"]["bounding_boxes"] == [[1.0, 2.0, 3.0, 4.0]] and got["m1"]["extracted_value"] == "5" and got["n1"]["confidence_score"] == 1.0
    assert {r["validation_status"] for r in got.values()} == {"APPROVED"} and [r["temp_id"] for r in rest.collect()] == ["m2"]
    with pytest.raises(Exception, match="no such page"):
        review.save_selected(staged, chosen.withColumn("page_number", F.lit(9)), pages)[0].collect()


# --- evaluation


def test_alignment_errors(spark):
    t = spark.createDataFrame([("a", 0, "x", "O"), ("a", 1, "y", "O"), ("b", 0, "q", "O")], "key string, pos int, token string, label string")
    assert evaluate.aligned(t, t.where("key = 'a'")).count() == 2
    with pytest.raises(Exception, match="token count mismatch in a"):
        evaluate.aligned(t, t.where("key = 'a' and pos = 0")).collect()
    with pytest.raises(Exception, match="token mismatch in a"):
        evaluate.aligned(t, t.withColumn("token", F.when(F.col("key") == "a", "z").otherwise(F.col("token")))).collect()


def test_reports(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "prediction int, reference int")
    got = {r["label"]: r for r in evaluate.classification_report(pairs, spark.createDataFrame([(0,), (1,)], "label int")).collect()}
    assert got["accuracy"]["f1"] == pytest.approx(2 / 3) and got["macro avg"]["f1"] == pytest.approx(2 / 3) and got["1"]["precision"] == 0.5
    rows = spark.createDataFrame([(1, k, r, p, i) for k, (r, p, i) in enumerate([("a", "a", False), ("x", "x", True), ("a", "a", False), ("O", "b", False)])], "seq_id int, pos int, ref string, pred string, ignored boolean")
    score = evaluate.entity_scores(rows).first()
    assert (score["tp"], score["fp"], score["fn"]) == (1, 1, 0)
    none = evaluate.entity_scores(rows.limit(0)).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    empty = evaluate.field_match(spark.createDataFrame([], "key string, field string, value string"), spark.createDataFrame([], "key string, field string, value string")).first()
    assert empty["rate"] is None


def test_first_box_wins_ties(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 50, 50, 60, 60)], "page_id long, token_index int, x0 int, y0 int, x1 int, y1 int")
    boxes = spark.createDataFrame([(1, 2, "late", 0, 0, 10, 10), (1, 1, "early", 0, 0, 10, 10)], "page_id long, box_order int, label string, x0 int, y0 int, x1 int, y1 int")
    assert {r["token_index"]: r["label"] for r in evaluate.best_overlap_labels(tokens, boxes).collect()} == {0: "early", 1: "O"}
    assert {r["token_index"]: r["label"] for r in evaluate.overlap_index(tokens, boxes).collect()} == {0: "late"}


def test_splits_keep_documents_together(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "document_id string")
    got = split.balanced_split(rows, fractions=(0.6, 0.2, 0.2), seed=7)
    assert got.count() == 4 and got.groupBy("document_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, split.balanced_split(rows, fractions=(0.6, 0.2, 0.2), seed=7).collect()))
    with pytest.raises(ValueError):
        split.hash_split(rows, fractions=(0.5, 0.2, 0.2))


# --- readers, writers, boundary


def test_json_and_xml(spark, tmp_path):
    record = {"document_id": "d", "page_id": 1, "tokens": ["a"], "bboxes": [[1, 2, 3, 4]], "labels": ["O"], "fields": {"x": "1"}}
    (tmp_path / "r.jsonl").write_text(json.dumps(record) + "\n\n" + json.dumps(record | {"labels": [], "tokens": [], "bboxes": []}) + "\n")
    rows = readers.read_jsonl(spark, str(tmp_path / "r.jsonl"))
    assert rows.count() == 2 and readers.token_examples(rows).count() == 1
    (tmp_path / "bad.jsonl").write_text("[1, 2\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    folder = tmp_path / "f" / "sub"
    folder.mkdir(parents=True)
    (folder / "two.json").write_text(json.dumps([record, record]))
    (tmp_path / "f" / "one.json").write_text(json.dumps(record, indent=1))
    assert readers.read_json_folder(spark, str(tmp_path / "f")).count() == 3
    with pytest.raises(Exception, match="differ in length"):
        readers.validated(rows.withColumn("labels", F.array(F.lit("O"), F.lit("O")))).collect()
    (tmp_path / "a.xml").write_text('<annotations><image name="p.png"><box label="total" xtl="1" ytl="2" xbr="30" ybr="12"/><box label="x" xtl="0.5" ytl="0" xbr="1" ybr="1"/></image></annotations>')
    images = readers.read_rectangles(spark, str(tmp_path / "a.xml"))
    tokens = spark.createDataFrame([("p.png", 1, 1, 0, "9", 10, 10, 20, 20, 2, 2, 30, 12)], "name string, document_id long, page_id long, token_index int, token string, x0 int, y0 int, x1 int, y1 int, ax0 int, ay0 int, ax1 int, ay1 int")
    got = export.rectangle_records(tokens, images).first()
    assert got["labels"] == ["total"] and got["bboxes"] == [[10, 10, 20, 20]]
    assert writers.write_jsonl(rows, str(tmp_path / "out")) == 2 and spark.read.json(str(tmp_path / "out")).count() == 2


def test_uploads_and_csv(spark, store, tmp_path):
    docs, pages, attributes, _ = store
    uploads = spark.createDataFrame([("a.PDF", "application/pdf"), ("a.pdf", "image/png"), ("b.exe", "application/pdf"), ("noext", None)], "name string, media_type string")
    assert [r["is_valid"] for r in readers.check_uploads(uploads).collect()] == [True, False, False, False]
    rows = search.export_rows(attributes.withColumn("bounding_boxes", F.array(F.array(F.lit(1.0)))), pages, docs, "ann")
    writers.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert list(back[0].asDict()) == list(writers.CSV_COLUMNS) and [r["bounding_boxes"] for r in back] == ["[[1.0]]"]
    writers.write_csv(rows.limit(0), str(tmp_path / "none"))
    assert json.loads(writers.as_json_documents(rows.drop("bounding_boxes")).first()["json"])["attributes"][0]["attribute_id"] == 100


def test_ocr_boundary(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "page-002.png").write_bytes(b"two words")
    images = readers.read_images(spark, str(tmp_path))

    def engine():
        return lambda data: [{"token": w, "x0": 0, "y0": 0, "x1": 1, "y1": 1, "conf_pct": 90.0, "block_num": 1, "paragraph_num": 1, "line_num": 1, "word_num": k} for k, w in enumerate(data.decode().split())]

    got = boundary.extract_tokens(images, engine).collect()
    assert [(r["page_number"], r["token"]) for r in got] == [(2, "two"), (2, "words")]


# --- streams


def test_ingest_and_status_streams(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"document_id": k, "text": f"hello {k}\nbye"}) for k in range(3)))
    gone = lambda: spark.createDataFrame([(1,)], "document_id long")
    run = lambda: ingest.run_ingest(ingest.stream_uploads(spark, str(source)), str(sink), str(tmp_path / "cp"), gone).awaitTermination(120)
    run()
    (source / "2.json").write_text(json.dumps({"document_id": 9, "text": "late"}))
    run()
    got = spark.read.parquet(str(sink))
    assert {r["document_id"] for r in got.collect()} == {0, 2, 9} and got.count() == 7
    events = tmp_path / "events"
    events.mkdir()
    row = lambda seq, target: json.dumps(dict(document_id=1, seq=seq, target=target, page_rows=1, page_count=1, has_started=True, has_timing=True))
    for k, target in enumerate(["QUEUED", "PROCESSING"]):
        (events / f"{k}.json").write_text(row(k, target))
        ingest.run_status(spark, str(events), str(tmp_path / "status"), str(tmp_path / "cp2")).awaitTermination(120)
    (events / "9.json").write_text(row(3, " approved ") + "\n" + row(2, "PROCESSED"))
    ingest.run_status(spark, str(events), str(tmp_path / "status"), str(tmp_path / "cp2")).awaitTermination(120)
    got = {(r["batch"], r["status"], r["n_accepted"], r["n_rejected"]) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert got == {(0, "QUEUED", 1, 0), (1, "PROCESSING", 2, 0), (2, "APPROVED", 4, 0)}


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    source = tmp_path / "w"
    source.mkdir()
    (source / "1.json").write_text('{"ts": "2026-01-01T00:10:00", "event_type": "a"}\n{"ts": "2026-01-01T05:00:00", "event_type": "a"}\n')
    stream = spark.readStream.schema("ts timestamp, event_type string").json(str(source))
    query = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["n"] for r in spark.sql("select * from windowed").collect()] == [1]


def test_softmax(spark):
    row = one(spark, evaluate.softmax(F.array(F.lit(1.0), F.lit(2.0))), evaluate.argmax_id(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert row[0][1] == pytest.approx(1 / (1 + math.exp(-1))) and row[1] == 1


def test_boxes_of_large_ids_keep_their_order(spark):
    """Ids near the end of the range, and an attribute with several boxes: the first of equal overlaps wins."""
    from docloom.operators import evaluate, export

    top = 2**62
    boxes = [[0.0, 0.0, 100.0, 100.0], [0.0, 0.0, 100.0, 100.0]]
    attributes = spark.createDataFrame([(1, top + 5, "later", boxes), (1, top + 4, "first", boxes), (1, -(2**63), "far", [[500.0, 500.0, 600.0, 600.0]])], "page_id long, id long, entity_type_label string, bounding_boxes array<array<double>>")
    tokens_ = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 500, 500, 600, 600)], "page_id long, token_index int, x0 int, y0 int, x1 int, y1 int")
    found = export.attribute_boxes_of(attributes)
    assert found.count() == 5
    assert {r["token_index"]: r["label"] for r in evaluate.best_overlap_labels(tokens_, found).collect()} == {0: "first", 1: "far"}
    assert {r["token_index"]: r["label"] for r in evaluate.overlap_index(tokens_, found).collect()} == {0: "later", 1: "far"}


@pytest.mark.parametrize("most", [0, 10])
def test_aliases_are_broadcast_only_where_they_are_few(spark, monkeypatch, most):
    monkeypatch.setattr(labels, "MOST_BROADCAST", most)
    rows = spark.createDataFrame([("Invoice", " Total"), ("form", "x")], "document_type string, label string")
    known = spark.createDataFrame([("invoice", "total", "total_amount")], "document_type string, alias string, canonical string")
    found = labels.normalize_labels(rows, known)
    assert {r["normalized_label"] for r in found.collect()} == {"total_amount", "x"}
    assert ("ResolvedHint" in found._jdf.queryExecution().analyzed().toString()) == (most > 0)
