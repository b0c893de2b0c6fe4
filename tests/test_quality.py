"""Merged sketches of confidences against the values themselves; bounds of small tables."""

import random

import numpy as np
import pytest

from docloom.operators import tokens as tok


def pages(spark, values):
    """values: (page, confidence)."""
    return spark.createDataFrame(values, "page_id long, conf_pct double")


@pytest.mark.parametrize("width", [0.25, 1.0, 7.0])
def test_quantiles_are_off_by_less_than_a_bin(spark, width):
    rng = random.Random(3)
    values = [(rng.randrange(40), rng.choice([rng.uniform(0, 100), rng.gauss(80, 5), 99.5])) for _ in range(4000)]
    values = [(p, min(max(v, 0.0), 100.0)) for p, v in values]
    sketches = tok.quality_sketches(pages(spark, values), width=width)
    names = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "p100": 1.0}
    for r in tok.merged_quality(sketches.selectExpr("page_id % 3 AS part", "bins"), "part", names).collect():
        mine = np.array([v for p, v in values if p % 3 == r["part"]])
        assert r["n"] == len(mine) and r["below_50"] == (mine < 50).sum() and r["mean"] == pytest.approx(mine.mean())
        assert all(abs(r[name] - np.quantile(mine, q)) < width for name, q in names.items())


def test_sketches_stored_apart_merge_to_those_of_all(spark):
    values = [(p, float((p * 31 + k * 17) % 101)) for p in range(12) for k in range(p * 9 + 1)]
    first, second = (tok.quality_sketches(pages(spark, [v for v in values if (v[0] < 5) == side])) for side in (True, False))
    one = "1 AS part"
    apart = tok.merged_quality(first.unionByName(second).selectExpr(one, "bins"), "part").collect()
    assert apart == tok.merged_quality(tok.quality_sketches(pages(spark, values)).selectExpr(one, "bins"), "part").collect()
    assert apart[0]["median"] == np.median([v for _, v in values])
    by_page = {r["page_id"]: r for r in tok.merged_quality(tok.quality_sketches(pages(spark, values)), "page_id").collect()}
    for r in tok.quality(pages(spark, values)).collect():  # a page alone is as the exact statistics have it
        assert (r["n"], r["below_50"]) == (by_page[r["page_id"]]["n"], by_page[r["page_id"]]["below_50"]) and r["median"] == pytest.approx(by_page[r["page_id"]]["median"])


def test_nulls_nan_ends_and_empty_tables(spark):
    rows = pages(spark, [(1, None), (1, float("nan")), (2, -5.0), (2, 100.0), (2, 1e9), (2, None), (None, 10.0)])
    found = {r["page_id"]: r for r in tok.merged_quality(tok.quality_sketches(rows), "page_id").collect()}
    assert found[1]["n"] == 2 and found[1]["mean"] is None and found[1]["median"] is None and found[1]["below_50"] == 0
    assert found[2]["n"] == 4 and found[2]["below_50"] == 1 and found[None]["median"] == 10.0
    assert tok.merged_quality(tok.quality_sketches(rows.limit(0)), "page_id").count() == 0
    with pytest.raises(ValueError):
        tok.quality_sketches(rows, width=0)


def test_a_keyword_table_over_its_bound_is_refused(spark):
    from docloom.operators import labels

    words = spark.createDataFrame([("a", 0, "one", 1), ("b", 1, "two", 2)], "document_type string, ordinal int, keyword string, weight int")
    docs = spark.createDataFrame([(1, "One and two")], "document_id long, text string")
    assert labels.classify(docs, words, most=2).first()["document_type"] == "b"
    with pytest.raises(ValueError):
        labels.classify(docs, words, most=1)
