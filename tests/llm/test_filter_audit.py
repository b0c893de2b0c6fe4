"""Filter interactions against running every order over the documents one by one."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import filter_audit
from docloom.llm.filter_audit import audit, measures, standard_filters, within


def test_within_sums_all_subsets():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        counts = rng.integers(0, 9, (1 << n, 2))
        wanted = [sum(counts[m] for m in range(1 << n) if m & t == m) for t in range(1 << n)]
        assert (within(counts) == np.array(wanted)).all()


def plain(rows, good):
    """By part, order and step, as the contract has it."""
    first, fails = {}, []
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        w = text.encode().split()
        fails.append((part or "", i in good, {"A": len(w) < 3, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i}))
    out = {}
    for part in {p for p, *_ in fails}:
        docs = [(g, f) for p, g, f in fails if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if d[1][name]]
                left = [d for d in left if not d[1][name]]
                total[name] += len(gone)
                failing = [d for d in docs if d[1][name]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for _, f in failing), sum(g for g, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def awkward(rng):
    texts = ["one two three four", "one one one one", "BIG LETTERS ARE HERE", "a # b c d", None, "", "é é é é", "tab\tnew\nline\x0bx", "x" * 300_000, "w " * 50_000]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""])) for _ in range(120)]


def test_every_order_equals_running_it(spark):
    rows = awkward(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("part", "mask", "digest", "words", "n", "first")})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)] + [(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    good = {k for k in range(40) if k % 3 == 0} | {1}
    got = audit(docs, standard_filters(min_words=3), labels, {"good": F.col("quality") == 1})
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got.collect()} == plain(rows, good)


def test_sums_over_orders_share_all_that_goes(spark):
    docs = spark.createDataFrame(awkward(random.Random(3)), "doc_id long, text string, source string")
    for part in audit(docs, standard_filters()).groupBy("part").agg(F.sum("removed").alias("all"), F.max(F.col("kept") + F.when(F.col("step") == 1, F.col("removed"))).alias("n"), F.min("kept").alias("least")).collect():
        assert part["all"] == math.factorial(5) * (part["n"] - part["least"])


def test_filters_of_ones_own_and_no_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    got = audit(docs, {"W": F.col("n_words") < 2, "X": F.lit(None).cast("boolean")}, copies=None)
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"]) for r in got.collect()) == [("WX", 1, 2, 1), ("WX", 2, 2, 0), ("XW", 1, 3, 0), ("XW", 2, 2, 1)]
    with pytest.raises(ValueError):
        audit(docs, {"AB": F.lit(True)})


@pytest.mark.parametrize("kind", ["string", "date", "binary", "decimal(38,0)", "double"])
def test_ids_of_any_type(spark, kind):
    df = spark.range(6).select(F.col("id").alias("n"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    ident = F.make_date(F.lit(2020), F.lit(1), F.col("n") + 1) if kind == "date" else F.col("n").cast("string").cast("binary") if kind == "binary" else F.col("n").cast(kind)
    got = audit(df.withColumn("doc_id", ident), {"W": F.col("n_words") < 2})
    assert got.where("filter_order = 'WE' and step = 2").first()["kept"] == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(docs, standard_filters(), spark.createDataFrame([], "doc_id long, q int"), {"good": F.col("q") == 1}).count() == 0
    assert measures(docs).count() == 0 and filter_audit.masks(docs, standard_filters()).count() == 0
