"""Substring search through an index of trigrams, verified by the search itself.

Postings say which documents have a gram in any of their texts: name, format, extracted attributes, and the labels and values of
their attributes. They and the grams' counts are tables of snapshots laid out by gram, so a search reads the few files that may
hold its grams. What has all of a needle's rarest grams is a candidate; documents and attributes are read for candidates only and
searched as ever, so the index decides what is read and never what is found. A needle without three characters in a row (wildcards
end a run) is searched for in everything. Texts that are null or shorter than three have no grams.

Postings are made where the texts are stored, block by block, and a block's documents with a gram are one row: a sorted list, of
integer ids the differences in as many bytes as they need. So the lists are shuffled, and no single (gram, document).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegralType, StructField, StructType

from ..sources.tables import MOST_VALUES, SnapshotTable
from .search import find_documents

#: Grams that are intersected at most: the rarest of the needle. More would only save verification.
MOST_GRAMS = 4
#: Characters of a block: what a task holds of its texts, or a little more.
_BLOCK = 1 << 21
#: Documents that leave a task at once when lists are read.
_ROWS = 1 << 16


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with `most` in all, or a row more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)) + 1
    yield from zip([0, *cuts], np.diff([0, *cuts, len(sizes)]), strict=True)


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and these."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of three characters within a text of lists of texts: the code points as one number, and the list's place. Texts that repeat are read once."""
    which, values = _coded(texts.flatten().fill_null(""))
    joined = pc.binary_join(pa.array([values], pa.list_(values.type)), "")[0].as_py()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(values)), pc.utf8_length(values).to_numpy())
    within = np.flatnonzero(text[:-2] == text[2:])
    codes = (points[within] << 42) | (points[within + 1] << 21) | points[within + 2]
    n = np.bincount(text[within], minlength=len(values))
    runs, starts = n[which], (np.cumsum(n) - n)[which]
    at = np.arange(runs.sum()) + np.repeat(starts - np.cumsum(runs) + runs, runs)
    return codes[at], np.repeat(pc.list_parent_indices(texts).to_numpy().astype(np.int64), runs)


def _packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of 64-bit integers, a list from each of `starts`, as the differences in groups of seven bits; the first of a list is 0. (where lists begin and end, bytes)"""
    steps = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    steps[starts] = 0
    size = 1 + sum((steps >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(size)
    data = np.zeros(ends[-1], np.uint8)
    for k in range(size.max()):
        live = np.flatnonzero(size > k)
        data[ends[live] - size[live] + k] = ((steps[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[live] > k + 1) << 7).astype(np.uint8)
    return np.append((ends - size)[starts], ends[-1]), data


def _unpacked(first: np.ndarray, n: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The integers of lists that ``_packed`` wrote one after the other: each list's first and how many it has."""
    ends = np.flatnonzero(data < 128) + 1
    begins = np.append(0, ends[:-1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins)
    steps = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins)
    total = np.cumsum(steps, dtype=np.uint64)
    return (total - np.repeat(total[np.cumsum(n) - n], n) + np.repeat(first.view(np.uint64), n)).view(np.int64)


def _block(ids: pa.Array, codes: np.ndarray, owners: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each gram of a block: its documents, each once and in order."""
    place, known = _coded(ids)
    which, grams = _coded(pa.array(codes))
    order = pc.sort_indices(known).to_numpy()
    known, grams, rank = known.take(pa.array(order)), grams.to_numpy(), np.argsort(np.argsort(grams.to_numpy()))
    pairs = np.sort(rank[which] * len(known) + np.argsort(order)[place][owners])
    which, place = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(known))
    grams = np.sort(grams)
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    chars = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    ends = np.append(starts, len(which))
    if pa.types.is_integer(known.type):
        bounds, data = _packed(known.to_numpy().astype(np.int64)[place], starts)
        lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])
    else:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(place)))
    columns = [pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)], pa.string()), known.take(pa.array(place[starts])), pa.array(np.diff(ends)), lists]
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def postings(documents: DataFrame, attributes: DataFrame) -> DataFrame:
    """(gram, first, n, documents): the list of documents that have a gram, its first and their number, for each block of either table's rows.

    A document whose rows lie in several blocks is in a list of each. Ids that aren't integers are listed as they are. No shuffle.
    """
    own = [F.col(c) if kind == "string" else F.to_json(c) for c, kind in documents.dtypes if c in ("name", "format", "extracted_attributes")]
    rows = documents.select(F.col("id").alias("document_id"), F.array(*[F.lower(c) for c in own]).alias("texts"))
    rows = rows.unionByName(attributes.select("document_id", F.array(F.lower("entity_type_label"), F.lower("extracted_value")).alias("texts"))).where("document_id is not null")
    kind = rows.schema["document_id"].dataType
    schema = StructType([*StructType.fromDDL("gram string"), StructField("first", kind), *StructType.fromDDL("n bigint"), StructField("documents", BinaryType() if isinstance(kind, IntegralType) else ArrayType(kind))])
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = chars = 0
        for batch in batches:
            texts = batch.column(1)
            sizes = np.bincount(pc.list_parent_indices(texts).to_numpy(), pc.binary_length(texts.flatten()).fill_null(0).to_numpy(), len(batch))
            for start, length in _portions(sizes.astype(np.int64) + 1, _BLOCK):
                codes, owners = _grams(texts.slice(start, length))
                held.append((batch.column(0).slice(start, length), codes, owners + rows))
                rows, chars = rows + length, chars + len(codes)
                if max(rows, chars) >= _BLOCK:
                    yield from block(held)
                    held, rows, chars = [], 0, 0
        yield from block(held)

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if any(len(codes) for _, codes, _ in held):
            yield _block(pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in (1, 2)), arrow)

    return rows.mapInArrow(blocks, schema)


def listed(lists: DataFrame) -> DataFrame:
    """(gram, document_id) of rows of ``postings``."""
    kind = lists.schema["first"].dataType
    if not isinstance(kind, IntegralType):
        return lists.select("gram", F.explode("documents").alias("document_id"))
    schema = StructType([lists.schema["gram"], StructField("document_id", kind)])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for start, length in _portions(n, _ROWS):
                if length:
                    part, count = batch.slice(start, length), n[start : start + length]
                    ids = _unpacked(part.column("first").to_numpy().astype(np.int64), count, np.frombuffer(b"".join(part.column("documents").to_pylist()), np.uint8))
                    grams = part.column("gram").take(pa.array(np.repeat(np.arange(length), count)))
                    yield pa.RecordBatch.from_arrays([grams, pa.array(ids).cast(arrow.field(1).type)], schema=arrow)

    return lists.select("gram", "first", "n", "documents").mapInArrow(rows, schema)


class TextIndex:
    """The index of documents and attributes at `path`, with copies laid out by document: of documents whole rows, of attributes what a search reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.documents, self.attributes, self.postings, self.counts = (SnapshotTable(spark, f"{path}/{name}") for name in ("documents", "attributes", "postings", "counts"))

    def build(self, documents: DataFrame, attributes: DataFrame, files: int | None = None) -> TextIndex:
        """Replace all four tables; postings last, so that what they name is there. A reader between two commits should wait for `build`."""
        self.documents.replace(documents, "id", files=files)
        self.attributes.replace(attributes.select("id", "document_id", "entity_type_label", "extracted_value"), "document_id", "id", files=files)
        found = self.postings.version()
        self.postings.replace(postings(self.documents.read(), self.attributes.read()), "gram", "first", files=files, base=found)
        self.counts.replace(self.postings.read().groupBy("gram").agg(F.sum("n").alias("n")), "gram", files=files)
        return self

    def rarest(self, q: str) -> list[str] | None:
        """The needle's rarest grams; None if it has none, an empty list if one of them is nowhere."""
        low = self.spark.range(1).select(F.lower(F.lit(q))).first()[0]  # as Spark lower-cases texts
        wanted = list(dict.fromkeys(run[i : i + 3] for run in re.split("[%_]", low) for i in range(len(run) - 2)))[:MOST_VALUES]
        if not wanted:
            return None
        counts = {r["gram"]: r["n"] for r in self.counts.lookup(gram=wanted).collect()}
        return sorted(wanted, key=lambda g: (counts[g], g))[:MOST_GRAMS] if len(counts) == len(wanted) else []

    def candidates(self, q: str) -> DataFrame | None:
        """document_id of all documents that have the needle's rarest grams; None where a needle has no grams."""
        rare = self.rarest(q)
        if rare is None:
            return None
        rows = self.postings.lookup(gram=rare) if rare else self.postings.read().where(F.lit(False))
        bit = sum((F.when(F.col("gram") == g, 1 << k).otherwise(0) for k, g in enumerate(rare)), F.lit(0))  # a document may be in several lists of a gram
        return listed(rows).groupBy("document_id").agg(F.bit_or(bit).alias("has")).where(F.col("has") == (1 << len(rare)) - 1).select("document_id")

    def find_documents(self, user: str, q: str, **filters) -> DataFrame:
        """The rows of ``search.find_documents``. Up to MOST_VALUES candidates are looked up in the files that may hold them; more are joined."""
        found = self.candidates(q)
        if found is None:
            return find_documents(self.documents.read(), self.attributes.read(), user, q=q, **filters)
        ids = [r[0] for r in found.limit(MOST_VALUES + 1).collect()]
        if len(ids) <= MOST_VALUES:
            documents, attributes = self.documents.lookup(id=ids), self.attributes.lookup(document_id=ids)
        else:
            documents = self.documents.read().join(found.withColumnRenamed("document_id", "id"), "id", "left_semi")
            attributes = self.attributes.read().join(found, "document_id", "left_semi")
        return find_documents(documents, attributes, user, q=q, **filters)
