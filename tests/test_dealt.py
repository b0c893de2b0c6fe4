"""Documents are dealt out before they are split: no token is shuffled after that. Folds by columns equal those by rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom import plans
from docloom.operators import cluster, tokens
from docloom.sources import boundary
from tests.conftest import SMALL
from tests.test_folds import COLUMNS, WORDS, model_clusters, token


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["model_predictions", "labelled_lines", "cluster_text", "page_texts", "page_lines"])
def test_only_documents_are_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange (\w+\(\w+)", plan) == ["hashpartitioning(doc_id"]


def test_pages_sketches_are_made_where_documents_lie(spark):
    plan = plans.QUERIES["source_quality"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(page_id" not in plan and "hashpartitioning(document_id" not in plan


@pytest.mark.parametrize("name", ["spatial_clusters", "pack_600"])
def test_tokens_reach_a_fold_unshuffled(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan[plan.index("MapInArrow"):]) == ["doc_id"]


def test_clusters_of_known_places_equal_the_model(spark, small_batches):
    rng, rows = random.Random(5), []
    for page in range(120):
        for k in range(rng.randrange(0, 40)):
            line = rng.randrange(1, 6)
            x, y = rng.randrange(0, 8) * 12, line * 12 + rng.randrange(0, 2)
            rows.append(token(page, k, rng.choice([*WORDS, " "]), rng.choice(["name", "date", ""]), (x, y, x + rng.randrange(-1, 14), y + rng.randrange(-1, 12)), rng.randrange(0, 101) / 100, 1 + rng.randrange(0, 8) // 7, 1 + rng.randrange(0, 6) // 5, line))
    got = cluster.spatial_clusters(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r["page_id"], r["cluster_index"]): (r["entity_type_label"], r["extracted_value"], r["bounding_boxes"], round(r["confidence_score"], 9)) for r in got} == model_clusters(rows)
    assert max(len(r["bounding_boxes"]) for r in got) > 4


def test_packing_over_many_batches(spark, small_batches):
    rng = random.Random(6)
    rows = [(page, par, k, rng.choice(["a", "ünï", " ", "x" * 9, "y" * 31, "z" * 45])) for page in range(20) for par in (2, 1) for k in range(par * -100, par * -100 + rng.randrange(0, 60))]
    wanted = {}
    for page in range(20):
        texts = []
        for par in (2, 1):
            text = ""
            for word in [w for p, q, _, w in rows if (p, q) == (page, par) and w.strip()]:
                if text and len(text) + 1 + len(word) > 40:
                    texts.append(text)
                    text = ""
                text = f"{text} {word}" if text else word
            texts += [text] if text else []
        wanted |= {(page, i): t for i, t in enumerate(texts, 1)}
    df = spark.createDataFrame(rows, "page_id long, paragraph_num int, token_index int, token string").withColumns({"block_num": F.lit(1), "conf_pct": F.lit(50)})
    got = cluster.packed_paragraphs(df, most=40).collect()
    assert {(r["page_id"], r["chunk_index"]): r["extracted_value"] for r in got} == wanted
    assert all(r["n_tokens"] == len(r["extracted_value"].split(" ")) and r["confidence_score"] == 0.5 for r in got)


def test_pages_labelled_at_once_equal_chunks_stitched(spark):
    def factory():
        def predict(words, boxes, kind):
            n = len(words)
            return [(None if k % 31 == 5 else f"{kind}{n % 7}", None if k % 29 == 3 else float("nan") if k % 37 == 4 else (k * 7 + n) % 10 / 10) for k in range(n)]

        return predict

    rows = [(page, k, f"w{k}", k, k + 1, k + 2, k + 3, "t") for page, n in enumerate((1, 20, 21, 29, 30, 200, 977)) for k in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, token_index int, token string, x0 int, y0 int, x1 int, y1 int, document_type string")
    pages = df.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("token_index", "token", F.array("x0", "y0", "x1", "y1").alias("box")))).alias("t"))
    part = F.slice("t", F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start"))
    chunks = tokens.chunk_ranges(pages, model_tokens=22).select("page_id", "chunk_start", F.lit("t").alias("document_type"), F.transform(part, lambda x: x["token"]).alias("tokens"), F.transform(part, lambda x: x["box"]).alias("bboxes"))
    wanted = tokens.fill_gaps(df, tokens.stitch(boundary.predict_pages(chunks, factory))).select("page_id", "token_index", "label", "confidence").collect()
    got = boundary.label_pages(df, factory, model_tokens=22).collect()
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and len(got) == len(rows)
    assert boundary.label_pages(df.limit(0), factory).count() == 0
