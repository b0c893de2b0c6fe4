"""Folds along sorted rows, where each row's fate depends on all rows before it.

Rows are dealt out by their group's keys and sorted; a task reads them as a stream
of Arrow batches, and what is remembered from row to row is the fold's own state,
so neither a page nor a label has to fit an array. Sorting spills where it must.
A group is read by one task, since a fold is sequential. ``fold_sorted`` hands rows
to the fold one by one, ``fold_blocks`` as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters and rows of results that leave a task at once.
_CHARS, _ROWS = 4 << 20, 4096


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], results: str, dealt: bool = False) -> DataFrame:
    """keys and what `fold` gives for each group: fold reads the group's rows (tuples of all columns) one by one, in order.

    results: DDL of what it gives. dealt: rows of equal keys share a partition already. Rows that `order` leaves equal come in any order.
    """
    schema = StructType([rows.schema[k] for k in keys] + list(StructType.fromDDL(results)))
    arrow, n = to_arrow_schema(schema), len(keys)
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for key, group in groupby(every, key=lambda row: row[:n]):
            for found in fold(group):
                out.append((*key, *found))
                chars += sum(len(x) for x in found if isinstance(x, str | list))
                if len(out) >= _ROWS or chars >= _CHARS:
                    yield flush()
                    out, chars = [], 0
        if out:
            yield flush()

    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def fold_blocks(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Callable[[pa.RecordBatch, bool], tuple[list, int]]], results: str, dealt: bool = False) -> DataFrame:
    """As ``fold_sorted``, for folds that take sorted rows as columns.

    fold: called once a task, gives a function (block, whether it is the last) -> (arrays of keys and results, the row from which on
    nothing is settled). Those rows come again at the head of the next block, so what a task holds is a batch and what was left open.
    """
    schema = StructType([rows.schema[k] for k in keys] + list(StructType.fromDDL(results)))
    arrow = to_arrow_schema(schema)
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, left, kept = fold(), [], 0

        def done(last: bool) -> pa.RecordBatch:
            nonlocal left, kept
            block = pa.concat_batches(left)
            out, at = step(block, last)
            left = [block.slice(at)] if at < block.num_rows else []
            kept = block.num_rows - at
            return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(out, arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(batch)
            if sum(b.num_rows for b in left) >= 2 * kept:  # a group left open over many batches isn't read again for each
                yield done(False)
        if left:
            yield done(True)

    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def starts_of(block: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row of a sorted block is the first with its keys; the block's first row is."""
    out = np.zeros(block.num_rows, bool)
    out[:1] = True
    for k in keys:
        c = block.column(k)
        now, before = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.fill_null(pc.not_equal(now, before), pc.not_equal(pc.is_null(now), pc.is_null(before)))
        out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def joined(texts: pa.Array, offsets: np.ndarray, sign: str) -> pa.Array:
    """The texts between neighbouring offsets, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), sign)
