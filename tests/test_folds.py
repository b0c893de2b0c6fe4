"""Folds against plain models in Python, on random pages and on the golden cases."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docloom.operators import cluster, tokens

WORDS = ["Acme", "Corp", "12", "due", "é", "total", "x"]


def token(page, k, text, label="name", box=(0, 0, 10, 10), conf=0.8, block=1, par=1, line=1):
    return (page, k, text, label, conf, *box, block, par, line)


COLUMNS = "page_id long, token_index int, token string, label string, confidence double, x0 int, y0 int, x1 int, y1 int, block_num int, paragraph_num int, line_num int"


def random_pages(rng, n):
    rows = []
    for page in range(n):
        for k in range(rng.randrange(0, 25)):
            x, y = rng.randrange(0, 120), rng.randrange(0, 60)
            rows.append(token(page, k, rng.choice([*WORDS, " "]), rng.choice(["name", "date", ""]), (x, y, x + rng.randrange(-2, 40), y + rng.randrange(-1, 12)), rng.randrange(0, 101) / 100, rng.randrange(0, 3), rng.randrange(0, 3), rng.randrange(0, 4)))
    return rows


class Cluster:
    """A growing cluster: what new tokens are compared with."""

    def __init__(self, t):
        self.members, self.block, self.par, self.line = [t], t[9], t[10], t[11]

    def takes(self, t):
        last = self.members[-1]
        unknown = lambda a, b: not a or not b or a == b
        w = max(max(0, last[7] - last[5]), max(0, t[7] - t[5]))
        h1, h2 = max(0, last[8] - last[6]), max(0, t[8] - t[6])
        common = min(last[8], t[8]) - max(last[6], t[6])
        on_line = self.line == t[11] if self.line and t[11] else common > 0 and common >= 0.25 * max(1, min(h1, h2))
        if on_line and unknown(self.block, t[9]) and unknown(self.par, t[10]):
            return t[5] - last[7] <= 1.5 * w
        drop = t[6] - last[8]
        return unknown(self.block, t[9]) and 0 <= drop <= 1.75 * max(h1, h2) and abs(t[5] - last[5]) <= 2 * w


def model_clusters(rows):
    found = {}
    for page in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == page and r[3].strip() and r[2].strip()]
        clusters = []
        for label in dict.fromkeys(r[3] for r in mine):
            open_ = None
            for t in sorted((r for r in mine if r[3] == label), key=lambda r: (r[9], r[10], r[11], r[6], r[5])):
                if open_ and open_.takes(t):
                    open_.members.append(t)
                else:
                    open_ = Cluster(t)
                    clusters.append(open_)
        clusters.sort(key=lambda c: min((m[9], m[10], m[11], m[6], m[5]) for m in c.members))
        for k, c in enumerate(clusters, 1):
            text = c.members[0][2]
            for before, t in zip(c.members, c.members[1:], strict=False):
                text += ("\n\n" if before[10] != t[10] else "\n" if before[11] != t[11] else " ") + t[2]
            found[page, k] = (c.members[0][3], text, [list(m[5:9]) for m in c.members], round(statistics.fmean(m[4] for m in c.members), 9))
    return found


def test_clusters_equal_the_model(spark):
    rows = random_pages(random.Random(2), 150)
    got = cluster.spatial_clusters(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r["page_id"], r["cluster_index"]): (r["entity_type_label"], r["extracted_value"], r["bounding_boxes"], round(r["confidence_score"], 9)) for r in got} == model_clusters(rows)


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([token(1, 0, "ok", conf=0.8)], [("ok", "APPROVED")]),
        ([token(1, 0, "ok", conf=0.74)], [("ok", "HITL")]),
        ([token(1, 0, "Alpha", box=(0, 0, 12, 10)), token(1, 1, "Beta", box=(31, 0, 43, 10))], [("Alpha", "APPROVED"), ("Beta", "APPROVED")]),
        ([token(1, 0, "Acme", box=(0, 0, 40, 10)), token(1, 1, "Corp", box=(0, 12, 40, 22), line=2)], [("Acme\nCorp", "APPROVED")]),
        ([token(1, 0, "First", box=(0, 0, 40, 10)), token(1, 1, "paragraph", box=(0, 12, 40, 22), par=2, line=2)], [("First\n\nparagraph", "APPROVED")]),
    ],
)
def test_golden_clusters(spark, rows, wanted):
    got = cluster.spatial_clusters(spark.createDataFrame(rows, COLUMNS)).orderBy("cluster_index").collect()
    assert [(r["extracted_value"], r["validation_status"]) for r in got] == wanted


OCR = "page_id long, document_type string, token_index int, token string, x0 int, y0 int, x1 int, y1 int, conf_pct double, block_num int, paragraph_num int, line_num int"


def ocr_lines(kind, lines, page=1):
    """Rows of a page from (paragraph, text) lines."""
    rows, k = [], 0
    for n, (par, text) in enumerate(lines, 1):
        for w in text.split(" "):
            rows.append((page, kind, k, w, k, k, k + 1, k + 1, float(50 + k % 50), 1, par, n))
            k += 1
    return rows


def model_lines(kind, lines):
    """(label, text, places of tokens) of labelled lines, by a list of open fields."""
    from docloom.schemas import line_label_map

    known, done, field, body, k = line_label_map()[kind], [], None, None, 0
    placed = []
    for par, text in lines:
        n = len(text.split(" "))
        placed.append((par, text, list(range(k, k + n))))
        k += n
    for par, text, places in sorted(placed, key=lambda x: (x[0], x[2])):  # lines are read by paragraph
        if not text.strip():
            continue
        head, colon, rest = text.partition(":")
        label, value = known.get(head.strip().lower()), rest
        if label is None:
            first, _, rest = text.partition(" ")
            label, value, colon = known.get(first.lower()), (rest.strip() if first.lower() in known else value), ""
        if label is not None and (colon or value.strip()):
            done += [x for x in (field, body) if x]
            words = len(value.split())
            field, body = (label, [value.strip()], places[-words:] if words else places), None
            continue
        if field and kind != "letter":
            field = (field[0], [*field[1], text], field[2] + places)
        elif field:
            done.append(field)
            field = None
        if kind == "letter" and label is None:
            if body and body[3] == par:
                body = (body[0], [*body[1], text], body[2] + places, par)
            else:
                done += [body] if body else []
                body = (f"body_{len(done) + 1}", [text], places, par)
    done += [x for x in (field, body) if x]
    return [(x[0], "\n".join(p for p in x[1] if p).strip(), x[2]) for x in done if "".join(x[1]).strip()]


def test_labelled_lines_equal_the_model(spark):
    rng, rows, wanted = random.Random(9), [], {}
    starts = ["Date:", "date", "To: ", "Subject", "Total: 5", "invoice number: 7 8", "name", "plain words here", "Bill to: Acme", "x"]
    for page in range(120):
        kind = rng.choice(["letter", "invoice", "form"])
        lines = [(rng.randrange(1, 3), (rng.choice(starts) + " " + rng.choice(["", "a b", "c"])).strip()) for _ in range(rng.randrange(1, 8))]
        rows += ocr_lines(kind, lines, page)
        if found := model_lines(kind, lines):
            wanted[page] = found
    got = {}
    for r in cluster.labelled_lines(spark.createDataFrame(rows, OCR)).orderBy("page_id", "field_index").collect():
        got.setdefault(r["page_id"], []).append((r["entity_type_label"], r["extracted_value"], [b[0] for b in r["bounding_boxes"]]))
    assert got == wanted


def test_golden_lines(spark):
    rows = ocr_lines("invoice", [(1, "Bill to: Acme"), (1, "Corporation")], 1) + ocr_lines("letter", [(1, "To: Ann"), (1, "Subject: Hello"), (2, "First body"), (3, "Second body")], 2) + ocr_lines("poem", [(1, "Date: x")], 3)
    got = [(r["page_id"], r["entity_type_label"], r["extracted_value"]) for r in cluster.labelled_lines(spark.createDataFrame(rows, OCR)).orderBy("page_id", "field_index").collect()]
    assert got == [(1, "bill_to", "Acme\nCorporation"), (2, "recipient", "Ann"), (2, "subject", "Hello"), (2, "body_3", "First body"), (2, "body_4", "Second body")]


def test_packing(spark):
    rows = ocr_lines("x", [(1 + k // 20, "word" * 3) for k in range(160)])
    got = cluster.packed_paragraphs(spark.createDataFrame(rows, OCR)).orderBy("chunk_index").collect()
    assert len(got) == 8 and got[0]["entity_type_label"] == "ocr_text_1" and sum(r["n_tokens"] for r in got) == 160
    assert all(len(r["extracted_value"]) <= 600 for r in got)
    long = spark.createDataFrame([(1, "x", k, w, 0, 0, 1, 1, 90.0, 1, 1, 1) for k, w in enumerate(["a" * 700, "b", "c" * 598, "d"])], OCR)
    assert [len(r["extracted_value"]) for r in cluster.packed_paragraphs(long).orderBy("chunk_index").collect()] == [700, 600, 1]
    one = cluster.packed_paragraphs(spark.createDataFrame(ocr_lines("x", [(1, "a b")]), OCR)).collect()
    assert [r["entity_type_label"] for r in one] == ["ocr_text"]


def test_three_pages_merge_as_two_and_one(spark):
    rows = [(1, p, 0, "f", f"v{p} ", 0.9 - p / 10, "APPROVED", [[p]]) for p in (1, 2, 3)] + [(2, 1, 0, "OCR", "a", 0.9, "APPROVED", [[1]]), (2, 2, 0, "OCR", "b", 0.9, "APPROVED", [[1]])]
    df = spark.createDataFrame(rows, "document_id long, page_number int, ordinal int, entity_type_label string, extracted_value string, confidence_score double, validation_status string, bounding_boxes array<array<int>>")
    got = [(r["document_id"], r["extracted_value"], round(r["confidence_score"], 2), r["validation_status"], r["bounding_boxes"]) for r in cluster.merge_continuations(df).orderBy("document_id", "row_index").collect()]
    assert got == [(1, "v1\n\nv2 ", 0.7, "HITL", [[1], [2]]), (1, "v3 ", 0.6, "APPROVED", [[3]]), (2, "a", 0.9, "APPROVED", [[1]]), (2, "b", 0.9, "APPROVED", [[1]])]


def test_gates_and_blank_pages(spark):
    rows = [(1, c) for c in (90.0, 10.0, 80.0, 5.0, 60.0)] + [(2, 26.0), (2, 27.0), (3, 85.0), (3, 90.0), (4, 25.0), (5, -1.0)]
    df = spark.createDataFrame([(p, k, c) for k, (p, c) in enumerate(rows)], "page_id long, token_index int, conf_pct double")
    gated = tokens.confidence_gate(df)
    assert sorted(r["conf_pct"] for r in gated.where("page_id = 1").collect()) == [60.0, 80.0, 90.0]
    assert {r["page_id"] for r in tokens.blank_pages(df, gated).collect()} == {2, 5}
    assert {r["page_id"] for r in tokens.kept_tokens(df).collect()} == {1, 3, 4}


def test_chunks_cover_all_tokens(spark):
    df = spark.createDataFrame([(n, n) for n in (0, 1, 509, 510, 511, 956, 957, 2000)], "page_id long, n_tokens int")
    got = {}
    for r in tokens.chunk_ranges(df).orderBy("chunk_start").collect():
        got.setdefault(r["page_id"], []).append((r["chunk_start"], r["chunk_end"]))
    assert got[0] == [(0, 0)] and got[510] == [(0, 510)] and got[511] == [(0, 510), (446, 511)] and got[956] == [(0, 510), (446, 956)] and len(got[957]) == 3
    for n, chunks in got.items():
        assert chunks[-1][1] == n and all(b[0] < a[1] for a, b in zip(chunks, chunks[1:], strict=False))


def test_stitching_prefers_confidence_then_the_earlier_chunk(spark):
    rows = [(1, 0, 3, 0, "t", "date", 0.4), (1, 2, 1, 0, "t", "vendor_name", 0.92), (1, 0, 0, 0, "u", "a", 0.5), (1, 0, 0, 1, "u", "b", 0.5)]
    df = spark.createDataFrame(rows, "page_id long, chunk_start int, local_index int, sub_index int, token string, label string, confidence double")
    assert {r["token_index"]: r["label"] for r in tokens.stitch(df).collect()} == {3: "vendor_name", 0: "a"}
    every = spark.createDataFrame([(1, k) for k in range(4)], "page_id long, token_index int")
    filled = {r["token_index"]: (r["label"], r["confidence"]) for r in tokens.fill_gaps(every, tokens.stitch(df)).collect()}
    assert filled[1] == ("hitl", 0.0) and filled[3] == ("vendor_name", 0.92)


def test_a_fold_reads_every_row_once_in_order(spark):
    from docloom.operators.folds import fold_sorted

    rng = random.Random(4)
    rows = [(k % 7 if k % 7 else None, rng.randrange(10**6), f"t{k}") for k in range(30_000)]

    def fold(group):
        last = count = None
        for _, n, text in group:
            assert last is None or last <= n
            last, count = n, (count or 0) + 1
            yield n, text + "é"
        yield -1, str(count)

    got = fold_sorted(spark.createDataFrame(rows, "k int, n long, text string"), ["k"], ["n"], fold, "n long, text string").collect()
    assert sorted((r["k"] or 0, r["n"], r["text"]) for r in got if r["n"] >= 0) == sorted((k or 0, n, t + "é") for k, n, t in rows)
    assert {r["k"]: int(r["text"]) for r in got if r["n"] < 0} == {k or None: sum((x[0] or 0) == k for x in rows) for k in range(7)}


def test_a_page_of_a_million_tokens(spark):
    """One page, one label: neither is one array on its way."""
    n = 1_000_000
    k, line = F.col("id"), F.floor(F.col("id") / 1000)
    big = spark.range(n).select(F.lit(1).alias("page_id"), k.cast("int").alias("token_index"), F.lit("ab").alias("token"), F.lit("name").alias("label"), F.lit(0.5).alias("confidence"), F.lit(50.0).alias("conf_pct"),
                                (k % 1000 * 30).cast("int").alias("x0"), (line * 60).cast("int").alias("y0"), (k % 1000 * 30 + 20).cast("int").alias("x1"), (line * 60 + 12).cast("int").alias("y1"), F.lit(1).alias("block_num"), F.lit(1).alias("paragraph_num"), (line + 1).cast("int").alias("line_num"))
    got = cluster.spatial_clusters(big).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("bounding_boxes")).alias("boxes"), F.max("cluster_index").alias("last")).first()
    assert (got["n"], got["boxes"], got["last"]) == (1000, n, 1000)
    got = cluster.packed_paragraphs(big).agg(F.sum("n_tokens").alias("n"), F.max(F.length("extracted_value")).alias("longest")).first()
    assert (got["n"], got["longest"]) == (n, 599)
