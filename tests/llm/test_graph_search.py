"""Graph search against brute force: recall, scores, ties, copies, awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import graph_search, queries
from docloom.llm.graph_search import Index, build, level, prune

DDL = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    """query id: the k nearest as (id, score), ties to smaller ids."""
    good = {(i, tuple(np.float32(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in good:
        if asked(q):
            found = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in good if i != q and len(x) == len(y))
            out[q] = [(i, pytest.approx(-s, rel=1e-9, abs=1e-12)) for s, i in found[:k]]
    return out


def searched(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(0) for c in ("id", "vec", "shard", "nodes", "ids", "query", "nth")})
    got = Index(df, keep=k, **options).search(df.where("vec_id % 4 = 0"), k=k).orderBy("query_id", "rank").collect()
    out = {}
    for r in got:
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_answered_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(80)]  # many ties, copies and zero vectors
    rows += [(100, None), (104, []), (108, [0.0] * 4), (112, [1.0, None, 0.0, 0.0]), (116, [float("nan"), 1.0, 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows += [(200 + k, [float(k), 1.0]) for k in range(6)] + rows[:10]  # another length; repeated rows
    assert searched(spark, rows) == brute(rows, lambda i: i % 4 == 0, 5)


def test_a_third_of_all_rows_are_one_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=6)] if k % 3 else [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for k in range(600)]
    assert searched(spark, rows) == brute(rows, lambda i: i % 4 == 0, 5)


def test_recall_over_several_shards_and_graphs(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(size=24) * rng.uniform(0.5, 2)]) for k in range(1600)]
    got, wanted = searched(spark, rows, k=10, most_nodes=300), brute(rows, lambda i: i % 4 == 0, 10)
    assert sorted(got) == sorted(wanted)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 10 for q in wanted]) > 0.97


def test_recall_of_the_query_is_over_nine_tenths(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_graph_search(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, a = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list()).astype(np.float64)
    asked = ids[ids % 20 == 0]
    scores = a[ids % 20 == 0] @ a.T
    scores[asked[:, None] == ids[None]] = -np.inf
    best = ids[np.argsort(-scores, axis=1, kind="stable")[:, :20]]
    found = got.sort_values(["query_id", "rank"])
    assert (found["query_id"].to_numpy().reshape(-1, 20)[:, 0] == asked).all() and (found["rank"].to_numpy().reshape(-1, 20) == np.arange(1, 21)).all()
    assert np.mean([len(set(x) & set(y)) / 20 for x, y in zip(best, found["vec_id"].to_numpy().reshape(-1, 20), strict=True)]) >= 0.9
    at = np.searchsorted(ids, found["vec_id"].to_numpy().reshape(-1, 20))
    assert np.allclose(np.take_along_axis(scores, at, 1), found["score"].to_numpy().reshape(-1, 20), rtol=1e-12)


def test_levelled_vectors_keep_the_order_of_inner_products():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 7)) * rng.uniform(1e-3, 1e3, (50, 1))
    y, q = level(x), graph_search.directions(rng.normal(size=(5, 7)))
    near = ((y[None] - q[:, None]) ** 2).sum(2)
    products = (q[:, :-1] / np.abs(x).max()) @ x.T
    assert np.corrcoef(near.ravel(), -products.ravel())[0, 1] > 0.999
    assert np.isfinite(level(np.array([[1e300, -1e308], [1e-300, 5.0]]))).all()


def test_pruning_keeps_what_no_kept_neighbour_is_nearer_to():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    got = prune(x, np.arange(40), np.tile(np.arange(40, dtype=np.int32), (40, 1)), 6, 1.2)
    for p in range(40):
        kept, left = [], sorted(set(range(40)) - {p}, key=lambda c: ((x[c] - x[p]) ** 2).sum())
        for c in left:
            if len(kept) < 6 and all(1.2 * np.linalg.norm(x[k] - x[c]) > np.linalg.norm(x[p] - x[c]) for k in kept):
                kept.append(c)
        assert [c for c in got[p] if c >= 0] == kept


def test_all_nodes_are_reached_from_the_entries():
    rng = np.random.default_rng(10)
    far = np.concatenate([rng.normal(size=(300, 4)) * 1e-3 + centre for centre in rng.normal(size=(6, 4)) * 100]).astype(np.float32)
    graph = build(far, degree=8, beam=16)
    nodes, gaps = graph.search(far[:20], len(far))
    assert (np.sort(nodes, 1) == np.arange(len(far))).all() and (np.diff(gaps, axis=1) >= 0).all()


def test_empty_tables_and_other_ids(spark):
    empty = spark.createDataFrame([], DDL)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], DDL)
    assert Index(empty).search(some).count() == 0 and Index(some).search(empty).count() == 0
    named = some.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    assert sorted(map(tuple, Index(named).search(named).collect())) == [("v1", 1, "v2", 0.5), ("v2", 1, "v1", 0.5)]
    with pytest.raises(ValueError):
        Index(some, keep=3).search(some, k=4)
