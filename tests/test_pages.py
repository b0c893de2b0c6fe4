"""Page decoding, the commands that start from files or tables, inserts, layout and times as shown."""

import json
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.functions import text
from docloom.operators import review
from docloom.schemas import ATTRIBUTES, DOCUMENTS, PAGES, TOKENS
from docloom.sources import boundary, pages, readers, writers


def filtered_png(image, kinds):
    """A PNG file whose rows use the given filters in turn, encoded byte by byte."""
    height, width, channels = image.shape
    out, above = bytearray(), [0] * (width * channels)
    for y in range(height):
        line, kind = image[y].reshape(-1).tolist(), kinds[y % len(kinds)]
        out.append(kind)
        for x, v in enumerate(line):
            a, b = (line[x - channels] if x >= channels else 0), above[x]
            c = above[x - channels] if x >= channels else 0
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda t: abs(a + b - c - t))][kind]
            out.append((v - guess) % 256)
        above = line
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    chunks = [(b"IHDR", head), (b"IDAT", zlib.compress(bytes(out))), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + b"\0\0\0\0" for k, d in chunks)


def tiff(frames, order="<", compression=1):
    """A TIFF file of gray or colour frames, each in strips of three rows."""
    out, links = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), 4
    pack = {1: bytes, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[k : k + 100]) - 1]) + d[k : k + 100] for k in range(0, len(d), 100))}[compression]
    for image in frames:
        image = image[..., None] if image.ndim == 2 else image
        strips = [pack(image[y : y + 3].tobytes()) for y in range(0, len(image), 3)]
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        at = {}
        for tag, values in ((273, places), (279, [len(s) for s in strips])):
            at[tag] = (len(out), values)
            out += struct.pack(f"{order}{len(values)}I", *values)
        tags = [(256, image.shape[1]), (257, image.shape[0]), (258, 8), (259, compression), (262, 1 if image.shape[2] == 1 else 2), (277, image.shape[2]), (278, 3)]
        entries = [struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags] + [struct.pack(order + "HHII", t, 4, len(v), p if len(v) > 1 else v[0]) for t, (p, v) in at.items()]
        struct.pack_into(order + "I", out, links, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(sorted(entries, key=lambda e: struct.unpack(order + "H", e[:2])))
        links = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("channels", [1, 3])
def test_png_filters_and_round_trip(channels):
    image = np.random.default_rng(3).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    wanted = image[..., 0] if channels == 1 else image
    assert pages.png_pages(filtered_png(image, [0, 1, 2, 3, 4]))[0].tolist() == wanted.tolist()
    assert pages.png_pages(pages.as_png(wanted))[0].tolist() == wanted.tolist()
    clear = np.concatenate([image, np.zeros((11, 7, 1), np.uint8)], axis=2)
    assert set(np.unique(pages.png_pages(filtered_png(clear, [4, 2]))[0])) == {255}
    with pytest.raises(ValueError):
        pages.png_pages(b"GIF89a")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 8, 32773])
def test_tiff_frames(order, compression):
    rng = np.random.default_rng(4)
    frames = [rng.integers(0, 256, (8, 5), dtype=np.uint8), rng.integers(0, 256, (2, 9, 3), dtype=np.uint8)]
    assert [x.tolist() for x in pages.tiff_pages(tiff(frames, order, compression))] == [x.tolist() for x in frames]
    assert pages._unpacked(bytes([254, 7, 128, 1, 8, 9])) == bytes([7, 7, 7, 8, 9])


def scan():
    image = np.full((100, 200), 255, np.uint8)
    image[20:30, 20:60] = image[60:70, 100:160] = 0
    return image


def test_predict_command(spark, tmp_path, capsys):
    root = tmp_path / "raw"
    (root / "doc").mkdir(parents=True)
    (root / "doc" / "page-002.png").write_bytes(pages.as_png(scan()))
    (root / "two.tif").write_bytes(tiff([scan(), np.full((9, 9), 255, np.uint8)]))
    assert cli.main(["predict", str(root), str(tmp_path / "p")]) == 0 and json.loads(capsys.readouterr().out) == {"records": 3}
    got = {(r["document_id"], r["page_id"]): r for r in readers.read_jsonl(spark, str(tmp_path / "p")).collect()}
    assert set(got) == {("doc", 2), ("two", 1), ("two", 2)}
    one = got["doc", 2]
    assert one["id"] == "doc/page-002" and one["labels"] == ["OCR", "OCR"] and one["confidences"] == [0.0, 0.0] and one["bboxes"] == [[100, 200, 300, 300], [500, 600, 800, 700]]
    assert got["two", 2]["tokens"] == [] and got["two", 2]["labels"] == []
    assert cli.main(["predict", str(root), str(tmp_path / "q"), "--engine", "docloom.sources.boundary:region_factory", "--predictor", "docloom.sources.boundary:stub_factory"]) == 0
    labelled = [r for r in readers.read_jsonl(spark, str(tmp_path / "q")).collect() if r["tokens"]]
    assert len(labelled) == 2 and all(len(r["labels"]) == len(r["tokens"]) == len(r["confidences"]) for r in labelled)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        cli.main(["predict", str(tmp_path / "none"), str(tmp_path / "r")])


def test_other_kinds_need_a_decoder(spark):
    files = spark.createDataFrame([("a/b.PDF", bytearray(b"x"))], "path string, content binary")
    got = pages.page_images(files, {".pdf": lambda: lambda data: [scan(), scan()]}).collect()
    assert [(r["page_number"], r["width"], r["height"]) for r in got] == [(1, 200, 100), (2, 200, 100)]
    with pytest.raises(Exception, match="no decoder"):
        pages.page_images(files).collect()


def test_export_and_training_commands(spark, tmp_path, capsys):
    tables = tmp_path / "tables"
    documents = spark.createDataFrame([(1, "a.pdf", "PDF", "u", "invoice", 1, None, None, None, None, "APPROVED", None)], DOCUMENTS)
    attributes = spark.createDataFrame([(7, 10, 1, "total", "say \"5\",\n6", [[0.0, 0.0, 1000.0, 1000.0]], None, 0.9, "APPROVED", "model"), (8, 10, 1, "x", "y", None, None, 0.9, "PENDING", "model")], ATTRIBUTES)
    page_rows = spark.createDataFrame([(10, 1, 1, None, None)], PAGES)
    tokens = spark.createDataFrame([(1, 10, 0, "5", 0, 0, 1000, 1000, 90.0, 1, 1, 1, 1)], TOKENS)
    for name, rows in (("documents", documents), ("attributes", attributes), ("pages", page_rows), ("tokens", tokens)):
        rows.write.parquet(f"{tables}/{name}.parquet")
    for command, kind in (("export", ["--format", "csv"]), ("export", ["--format", "json"]), ("training", [])):
        assert cli.main([command, str(tables), str(tmp_path / "".join(kind + [command])), *kind]) == 0
        assert json.loads(capsys.readouterr().out) == {"records": 1}
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "--formatcsvexport")).first()
    assert got["extracted_value"] == "say \"5\",\n6"
    assert spark.read.json(str(tmp_path / "training")).first()["labels"] == ["total_amount"]


def test_queued_documents_are_appended_once(spark):
    documents = spark.createDataFrame([], DOCUMENTS)
    uploads = spark.createDataFrame([(1, "a.PDF", "application/pdf", "u", None), (1, "a.PDF", "application/pdf", "u", None), (2, "b.pdf", "image/png", "u", None)], "document_id long, name string, media_type string, owner_id string, timestamp timestamp")
    rows, refused = review.queued_documents(uploads, documents)
    assert rows.dtypes == documents.dtypes and [(r["id"], r["format"], r["status"]) for r in rows.collect()] == [(1, "pdf", "QUEUED")]
    assert [r["document_id"] for r in refused.collect()] == [2]
    assert review.queued_documents(uploads, documents.unionByName(rows))[0].count() == 0


def test_status_outside_of_a_plan_equals_the_plan(spark):
    names = [*review.TRANSITIONS, "OTHER"]
    rows = [(s, t, n, c, started, timing) for s in review.TRANSITIONS for t in names for n, c in ((0, 0), (2, 2), (2, 3), (None, 1)) for started in (True, None) for timing in (True, False)]
    df = spark.createDataFrame(rows, "status string, target string, page_rows int, page_count int, has_started boolean, has_timing boolean")
    event = F.struct("page_rows", "page_count", "has_started", "has_timing")
    got = df.select("*", review.accepted(F.col("status"), F.col("target"), event).alias("ok")).collect()
    assert all(r["ok"] == review.may_follow(*r[:6]) for r in got) and {r["ok"] for r in got} == {True, False}


def test_clustered_tables(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 10).alias("owner_id"), F.col("id").alias("document_id"))
    writers.write_clustered(rows, str(tmp_path / "t"), "owner_id", "document_id", files=5)
    per = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).agg(F.min("owner_id").alias("a"), F.max("owner_id").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in per) == 1000 and len(per) > 1 and all(r["b"] - r["a"] < 9 for r in per)


def test_times_as_shown(spark):
    now = datetime(2026, 3, 9, 12)
    ages = [timedelta(seconds=5), timedelta(minutes=59, seconds=29), timedelta(minutes=59, seconds=31), timedelta(hours=23), timedelta(hours=47)]
    df = spark.createDataFrame([(k, now - a) for k, a in enumerate(ages)] + [(9, None)], "k int, t timestamp")
    got = {r["k"]: (r["age"], r["day"]) for r in df.select("k", text.age_shown(F.col("t"), F.lit(now)).alias("age"), text.date_shown(F.col("t")).alias("day")).collect()}
    assert [got[k][0] for k in (0, 1, 2, 3, 4, 9)] == ["1 min ago", "59 min ago", "1 hr ago", "23 hr ago", "2 d ago", "Just now"]
    assert got[0][1] == "Mar 9, 2026" and got[9][1] == "Unknown date"


def test_named_factories():
    assert boundary.named_factory("docloom.sources.boundary:stub_factory") is boundary.stub_factory
