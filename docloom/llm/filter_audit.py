"""What each filter of a chain takes away, alone and after any others.

Method. Every document gets a mask: bit k says that filter k rejects it. Only
the counts by part and mask leave the rows (at most 2 ** n a part, summed before
any shuffle). The subset-zeta transform turns a part's counts into the number of
documents whose mask lies within T, for every T at once: n passes over 2 ** n
numbers. The survivors of a set S of filters are those within the complement of
S, so a step of any order is the difference between neighbouring sets, and a
filter's sum over all orders is one sum over the sets without it. Counts of
labelled documents take the same way.

A document that repeats an earlier one is found by its text's SHA-256: the
smallest id of each text is a partial minimum, and only rows that are such a
first one find a partner in the join on (id, hash), so no group of copies meets
in a task.

Defined results: null texts are empty; each row counts, repeated ones too; a row
with a null id repeats nothing and is repeated by nothing; rows that repeat both
id and text are not copies of each other; a null condition or label is false; a
document is labelled if any of its label rows is; a null part is the empty
string; an empty table gives no parts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored

#: Orders are written out one by one: 8 filters have 40 320.
MOST_FILTERS = 8
#: Fixed by the contract: capitals and marks. Words are what ASCII white space separates, as bytes.split() has it.
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_MEASURES = "n_chars long, n_words long, n_distinct long, n_upper long, n_marks long, digest binary"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, digests = batch.column("text"), [], []
        for k in range(batch.num_rows):
            raw = texts[k].as_buffer().to_pybytes()
            words = raw.split()
            counts.append((len(words), len(set(words)), *(len(raw) - len(raw.translate(None, x)) for x in (UPPER, MARKS))))
            digests.append(hashlib.sha256(raw).digest())
        columns = list(zip(*counts, strict=True)) or [()] * 4
        rest = [x.strip().split(" ")[0] for x in _MEASURES.split(",")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pc.utf8_length(texts).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.binary())], ["doc_id", "part", *rest]
        )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, n_chars, n_words, n_distinct (words), n_upper (A-Z), n_marks (#$%&*|) and digest (SHA-256) of every text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_measured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, {_MEASURES}")


def standard_filters(min_words: int = 50, distinct_percent: int = 65, upper_percent: int = 5) -> dict[str, Column]:
    """Conditions on ``measures`` under which a document fails, by name."""
    return {
        "A": F.col("n_words") < min_words,
        "B": 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        "C": 100 * F.col("n_upper") > upper_percent * F.col("n_chars"),
        "D": F.col("n_marks") > 0,
    }


def masks(docs: DataFrame, filters: dict[str, Column], copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and mask (bit k: fails the k-th filter) of every row; copies names one filter more, the last: the text is that of a smaller id."""
    rows = measures(docs, id_col, text_col, part_col)
    mask = F.lit(0)
    for k, condition in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(condition, 1 << k).otherwise(0))
    rows = rows.select("doc_id", "part", mask.alias("mask"), "digest")
    if copies is None:
        return rows.drop("digest")
    rows = stored(rows, "filter-masks")  # texts are read once
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).select("first", F.col("digest").alias("first_digest"))
    rows = rows.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("first_digest")), "left")
    again = F.col("doc_id").isNotNull() & F.col("first_digest").isNull()
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(again, 1 << len(filters)).otherwise(0)).alias("mask"))


def within(counts: np.ndarray) -> np.ndarray:
    """Subset-zeta transform along the first axis: out[T] is the sum of counts[m] over all m within T."""
    out = counts.copy()
    for k in range(len(out).bit_length() - 1):
        pairs = out.reshape(-1, 2, 1 << k, *out.shape[1:])
        pairs[:, 1] += pairs[:, 0]
    return out


def steps(names: str, counts: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique fails, removed by the sum over all orders, labelled removed ...) for each step of each order.

    counts has a row for each mask: documents, then labelled ones by label.
    """
    n, full = len(names), len(counts) - 1
    surviving = within(counts)[full - np.arange(full + 1)]  # the complement of each set
    gone = {k: surviving - surviving[np.arange(full + 1) | 1 << k] for k in range(n)}  # by the set that ran before
    size = np.array([s.bit_count() for s in range(full + 1)])
    orders = np.array([math.factorial(s) * math.factorial(n - 1 - s) if s < n else 0 for s in range(n + 1)])
    shapley = {k: int((gone[k][:, 0] * orders[size])[(np.arange(full + 1) >> k & 1) == 0].sum()) for k in range(n)}
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            removed = gone[k][before]
            before |= 1 << k
            yield "".join(names[x] for x in order), step, int(surviving[before, 0]), int(removed[0]), int(gone[k][0, 0] - removed[0]), int(counts[1 << k, 0]), shapley[k], *map(int, removed[1:])


def _written(names: str, labels: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley", *(f"{x}_lost" for x in labels)]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(columns) - 3)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("found").to_pylist(), strict=True):
                counts = np.zeros((1 << len(names), 1 + len(labels)), dtype=np.int64)
                for x in found:
                    counts[x["mask"]] = [x["n"], *(x[f"n_{label}"] for label in labels)]
                rows = [(part, *step) for step in steps(names, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    return stream


def audit(
    docs: DataFrame, filters: dict[str, Column], labels: DataFrame | None = None, marked: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, shapley and, for each label, <label>_lost.

    filters: conditions on ``measures`` by names of one letter; marked: conditions on the columns of `labels` by label.
    """
    names, marked = "".join([*filters, copies or ""]), marked or {}
    if len(names) != len(filters) + bool(copies) or len(set(names)) < len(names) or len(names) > MOST_FILTERS:
        raise ValueError(f"filters have different names of one letter, {MOST_FILTERS} at most; these are {[*filters, copies]}")
    rows = masks(docs, filters, copies, id_col, text_col, part_col)
    sums = [F.count(F.lit(1)).alias("n")]
    if labels is not None and marked:
        any_of = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"is_{name}") for name, c in marked.items()]
        per = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(*any_of)
        rows = rows.join(per, F.col("doc_id") == F.col("labelled"), "left")
        sums += [F.coalesce(F.sum(f"is_{name}"), F.lit(0)).alias(f"n_{name}") for name in marked]
    counts = rows.groupBy("part", "mask").agg(*sums)
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *[c for c in counts.columns if c.startswith("n")])).alias("found"))
    kept = list(marked) if labels is not None else []
    more = "".join(f", {x}_lost long" for x in kept)
    return per_part.mapInArrow(_written(names, kept), f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long{more}")
