"""Lines that many documents share are dropped everywhere.

Each document yields one row per distinct line key: a 128-bit hash, the
document and the key's positions. The rows are range-partitioned by (hash,
document) with a secondary sort, so a key that a third of all documents hold is
spread over as many partitions as its rows fill. Each sorted partition is
streamed once. A key whose run lies inside a partition is decided there; a run
at a partition's edge may go on next door, so it leaves a count (at most two a
partition) and those of its rows that are not decided yet (fewer than
`min_docs` an edge). The result is a compressed bitmap per document, never text.

Defined results: a null or empty text is one empty line; an empty key is never
dropped; repeated rows count once (see ``common``); an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_HASH, by_document, identified, identity, shuffle_parts, stored

#: Fixed by the contract: what is stripped from both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
DROP, OPEN, EDGE = 0, 1, 2
_LINES = "n_lines int, positions array<int>"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z only


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column("doc_id").to_pylist(), batch.column(TEXT_HASH).to_pylist(), batch.column("text")
        digests, out_id, out_hash, out_n, out_at = [], [], [], [], []
        for k in range(batch.num_rows):
            lines = texts[k].as_buffer().to_pybytes().split(b"\n")
            at: dict[bytes, list[int]] = {}
            for pos, line in enumerate(lines):
                if key := line_key(line):
                    at.setdefault(key, []).append(pos)
            digests += map(xxhash.xxh3_128_digest, at)
            out_at += at.values()
            out_id += [ids[k]] * len(at)
            out_hash += [hashes[k]] * len(at)
            out_n += [len(lines)] * len(at)
        halves = np.frombuffer(b"".join(digests), dtype=">i8").astype("i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(out_id, batch.column("doc_id").type), pa.array(out_hash, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_at, pa.list_(pa.int32()))],
            ["h1", "h2", "doc_id", TEXT_HASH, "n_lines", "positions"],
        )


def _decide(min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "n", "h1", "h2", "doc_id", TEXT_HASH, "n_lines", "positions"]
        types: list[pa.DataType] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        key, count, seen, held, first = None, 0, None, [], True

        def close(edge: bool) -> None:
            """The run of `key` ends: leave its count and what is undecided if it touches an edge."""
            if edge and key is not None:
                out.append((EDGE, count, *key, None, None, None, None))
                out.extend((OPEN, None, *key, *row) for row in held)

        for batch in batches:
            types = types or [pa.int32(), pa.int32(), *[pa.int64()] * 2, batch.column("doc_id").type, pa.int64(), pa.int32(), pa.list_(pa.int32())]
            columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", TEXT_HASH, "n_lines", "positions")]
            for h1, h2, doc, text_hash, n_lines, positions in zip(*columns, strict=True):
                if (h1, h2) != key:
                    close(edge=first)
                    first = first and key is None
                    key, count, seen, held = (h1, h2), 0, None, []
                if (doc, text_hash) == seen:
                    continue  # a repeated row
                seen, count = (doc, text_hash), count + 1
                held.append((doc, text_hash, n_lines, positions))
                if count >= min_docs:  # from here on each row of the run is emitted as it comes
                    out.extend((DROP, None, *key, *row) for row in held)
                    held = []
            if len(out) > 5000:
                yield flush()
        close(edge=True)
        if out:
            yield flush()

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, groups in zip(batch.column("n_lines").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            keep = np.ones(n, dtype=bool)
            for positions in groups:
                keep[positions] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column(TEXT_HASH), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            ["doc_id", TEXT_HASH, "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """doc_id, text hash, n_lines, n_dropped and keep_bitmap (zlib over packed bits, 1: keep) of the documents that lose lines."""
    docs = identified(docs, id_col, text_col)
    ident = identity(docs)
    order = ["h1", "h2", "doc_id", TEXT_HASH]
    keys = docs.mapInArrow(_key_rows, f"h1 long, h2 long, {ident}, {_LINES}")
    keys = keys.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    runs = stored(keys.mapInArrow(_decide(min_docs), f"kind int, n int, h1 long, h2 long, {ident}, {_LINES}"), "line-runs")
    total = runs.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("total")).where(F.col("total") >= min_docs)
    late = runs.where(F.col("kind") == OPEN).join(total, ["h1", "h2"], "left_semi")
    lost = runs.where(F.col("kind") == DROP).unionByName(late.select(*runs.columns))
    per_doc = lost.groupBy("doc_id", TEXT_HASH).agg(F.first("n_lines").alias("n_lines"), F.collect_list("positions").alias("groups"))
    return per_doc.mapInArrow(_bitmaps, f"{ident}, n_lines int, n_dropped long, keep_bitmap binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, maps = batch.column("text"), batch.column("keep_bitmap")
        out, n_lines = [], []
        for k in range(batch.num_rows):
            if not maps[k].is_valid:
                out.append(texts[k].as_py())
                n_lines.append(texts[k].as_buffer().to_pybytes().count(b"\n") + 1)
                continue
            lines = texts[k].as_py().split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(maps[k].as_py()), dtype=np.uint8))[: len(lines)]
            out.append("\n".join(line for line, stays in zip(lines, keep, strict=True) if stays))
            n_lines.append(len(lines))
        at = batch.schema.get_field_index("keep_bitmap")
        rest = [c for k, c in enumerate(batch.columns) if k != at]
        names = [f.name for k, f in enumerate(batch.schema) if k != at]
        rest[names.index("text")] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n_lines, pa.int64())], [*names, "n_lines"])


def apply_bitmaps(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """rows (as from ``identified``, with any further columns) with the kept text, n_dropped and n_lines (before dropping)."""
    joined = by_document(rows, maps, keep=("n_dropped", "keep_bitmap")).drop(TEXT_HASH)
    joined = joined.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "keep_bitmap")
    return joined.mapInArrow(_kept, f"{schema}, n_lines long")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """doc_id, kept text, n_dropped and n_lines (before dropping) of every row of docs."""
    maps = keep_bitmaps(docs, id_col, text_col, min_docs)
    return apply_bitmaps(identified(docs, id_col, text_col), maps)
