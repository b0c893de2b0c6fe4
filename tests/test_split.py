"""Balanced splits against the sequential fill that defines them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import split

FRACTIONS = (0.6, 0.2, 0.2)


def sequential(sizes, fractions=FRACTIONS, seed=7):
    """Groups by the hash of their names, each to the split that is least full for its target."""
    targets, filled, out = [f * sum(sizes.values()) for f in fractions], [0, 0, 0], {}
    for g in sorted(sizes, key=lambda g: hashlib.md5(f"{g}:{seed}".encode()).hexdigest()):
        k = min(range(3), key=lambda i: filled[i] / targets[i] if targets[i] else float("inf"))
        filled[k] += sizes[g]
        out[g] = split.NAMES[k]
    return out


def examples(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "document_id long, n int")
    return rows.select("document_id", F.explode(F.sequence(F.lit(1), "n")).alias("example"))


def assigned(rows):
    found = rows.groupBy("document_id").agg(F.collect_set("split").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(len(r["s"]) == 1 for r in found)
    return {r["document_id"]: r["s"][0] for r in found}, {r["document_id"]: r["n"] for r in found}


def drawn(kind, n=3000):
    rng = random.Random(kind)
    sizes = {i * 7919: {"even": lambda: 2 * rng.randint(1, 3), "ones": lambda: 1, "tail": lambda: int(rng.paretovariate(1.2)) % 500 + 1}.get(kind, lambda: rng.randint(1, 9))() for i in range(n)}
    if kind == "hot":  # one group holds a third of all rows
        sizes[7919] = sum(sizes.values()) // 2
    return sizes


@pytest.mark.parametrize("kind", ["mixed", "even", "ones", "tail", "hot"])
@pytest.mark.parametrize("parts", [1, 24])
def test_parts_filled_at_once_give_the_sequential_split(spark, monkeypatch, kind, parts):
    sizes, folds, run = drawn(kind), [], split.fold_sorted
    monkeypatch.setattr(split, "fold_sorted", lambda rows, *rest, **kw: folds.append(1) or run(rows, *rest, **kw))
    got, counts = assigned(split.balanced_split(examples(spark, sizes), fractions=FRACTIONS, seed=7, parts=parts))
    assert got == sequential(sizes) and counts == sizes
    assert len(folds) <= 2 + (1 if parts == 1 else 8)  # estimates, rounds, result


def test_nulls_zero_fractions_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (4, 1), (5, 1)], "document_id long, n int")
    for fractions in (FRACTIONS, (1.0, 0.0, 0.0), (0.5, 0.5, 0.0)):
        got, counts = assigned(split.balanced_split(rows, fractions=fractions, seed=7, parts=5))
        assert got == sequential({None: 2, 4: 1, 5: 1}, fractions) and counts == {None: 2, 4: 1, 5: 1}
    clashing = rows.withColumnRenamed("n", "filled").withColumn("picked", F.lit(1))
    assert split.balanced_split(clashing, parts=3).columns == ["document_id", "filled", "picked", "split"]
    assert split.balanced_split(rows.limit(0), parts=4).count() == 0
    with pytest.raises(ValueError):
        split.balanced_split(rows, parts=0)
