"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's windows (n consecutive words; an item of fewer is one window)
go to the executors as a hash set. Its size is checked: the items are dealt
into blocks of at most `block_words` words and each block is one broadcast, so
what is sent at once is bounded however large the benchmark grows. Documents
are scanned where they lie, without a shuffle; a hash that matches is verified
word by word. With several blocks the hits of each are merged by document.

Defined results: null and empty texts have no words and are never
contaminated; items without words have no window; repeated items all count; an
item with a null id hits like any other and counts as one item (all of them
together), but is not in the list of ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_HASH, bound_batches, by_document, identified, identity, share, text_runs, value_of

#: Fixed by the contract: words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words where they stand in a text.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    # split(b" ") and not split(): bytes beyond ASCII are never separators, and the table leaves spaces only.
    return [w for w in text.translate(_WORD).split(b" ") if w]


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


class WindowSet:
    """The windows of one block of items, by rolling hash over word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), n):
                key = tuple(self.number.setdefault(w, len(self.number)) for w in window)
                found.setdefault(key, set()).add(item)
        self.windows = list(found)
        self.items = [sorted(found[w], key=str) for w in self.windows]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(w) for w in self.windows}):
            at = np.array([k for k, w in enumerate(self.windows) if len(w) == length])
            hashes = self.roll(np.array([self.windows[k] for k in at], dtype=np.int64).reshape(-1), length)[::length]
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = hashes[order], at[order]

    @staticmethod
    def roll(numbers: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of `length` numbers; a wrapped polynomial, so equal runs have equal hashes."""
        if len(numbers) < length:
            return np.zeros(0, dtype=np.uint64)
        values = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        out = np.zeros(len(numbers) - length + 1, dtype=np.uint64)
        for k in range(length):
            out = out * _PRIME + values[k : len(values) - length + 1 + k]
        return out

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, length, window) of each verified occurrence; numbers below 0 are no word of any window."""
        unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
        for length, (hashes, at) in self.by_length.items():
            rolled = self.roll(numbers, length)
            if not len(rolled):
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            got = rolled[starts]
            low = np.searchsorted(hashes, got)
            possible = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == got))
            for start, k in zip(starts[possible].tolist(), low[possible].tolist(), strict=True):
                seen, here = hashes[k], tuple(numbers[start : start + length].tolist())
                while k < len(hashes) and hashes[k] == seen:
                    if self.windows[at[k]] == here:
                        yield start, length, int(at[k])
                    k += 1


def _found(windows: WindowSet, texts: pa.Array) -> tuple[list[int], list[list[list[int]]], list[set[str | None]]]:
    """Of each text: number of words, merged hit word spans, items hit."""
    number = windows.number.get
    runs, ends = [], []
    for k in range(len(texts)):
        runs += [number(w, -1) for w in words_of(texts[k].as_buffer().to_pybytes())]
        runs.append(-1)  # no window reaches across documents
        ends.append(len(runs))
    starts = np.array([0, *ends[:-1]])
    spans: list[list[tuple[int, int]]] = [[] for _ in ends]
    items: list[set[str | None]] = [set() for _ in ends]
    for start, length, window in windows.hits(np.array(runs, dtype=np.int64)):
        doc = int(np.searchsorted(starts, start, side="right")) - 1
        spans[doc].append((start - int(starts[doc]), start - int(starts[doc]) + length))
        items[doc].update(windows.items[window])
    return [e - s - 1 for s, e in zip(starts.tolist(), ends, strict=True)], [merged(s) for s in spans], items


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _clean(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that aren't contaminated, as they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = value_of(shared)
        for whole in batches:
            for batch in text_runs(whole):
                n_words, spans, _ = _found(windows, batch.column("text"))
                bad = [is_contaminated(n, sum(e - s for s, e in x)) for n, x in zip(n_words, spans, strict=True)]
                yield batch.filter(pa.array([not x for x in bad], pa.bool_()))

    return scan


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = value_of(shared)
        for whole in batches:
            for batch in text_runs(whole):
                n_words, spans, items = _found(windows, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column(TEXT_HASH),
                        pa.array(n_words, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                        pa.array([sorted(i, key=str) for i in items], pa.list_(pa.string())),
                    ],
                    ["doc_id", TEXT_HASH, "n_words", "spans", "items"],
                )

    return scan


def merged(spans) -> list[list[int]]:
    """The union of half-open spans, as disjoint ones that don't touch, in order."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged(x for group in groups for x in group) for groups in batch.column("spans").to_pylist()]
        items = [{x for group in groups for x in group} for groups in batch.column("items").to_pylist()]
        listed = [sorted(i for i in x if i is not None) for x in items]
        n_words = batch.column("n_words").to_pylist()
        hit = [sum(e - s for s, e in x) for x in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column(TEXT_HASH),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
                pa.array([is_contaminated(n, h) for h, n in zip(hit, n_words, strict=True)], pa.bool_()),
                pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            ],
            ["doc_id", TEXT_HASH, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )


def _pieces(n: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as normalised texts of at most `most` words; pieces of a longer item overlap by n - 1 words, so they have the same windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str, int]] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of((text or "").encode())
                for k in range(0, max(1, len(words) - n + 1), most - n + 1) if words else ():
                    out.append((item, b" ".join(words[k : k + most]).decode(), len(words[k : k + most])))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["item_id", "text", "n"])

    return cut


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items' windows in blocks of at most block_words words; the driver holds a block at a time. One empty block if there are none."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    items = items.mapInArrow(_pieces(n, max(2 * n, block_words // 16)), "item_id string, text string, n long")
    block, held = [], 0
    for row in items.toLocalIterator():
        if held and held + row["n"] > block_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"].encode()))
        held += row["n"]
    yield block


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """docs without its contaminated rows (null texts become empty). With one block of items that is a filter, without any shuffle."""
    blocks = _blocks(benchmark, item_col, item_text_col, n, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        rows = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).withColumnRenamed(text_col, "text")
        return rows.mapInArrow(_clean(share(docs.sparkSession, WindowSet(first, n))), rows.schema).withColumnRenamed("text", text_col)
    bad = contamination(docs, benchmark, docs.columns[0], text_col, item_col, item_text_col, n, block_words).where("contaminated")
    rows = identified(docs, docs.columns[0], text_col, *(F.col(c).alias(f"__{k}") for k, c in enumerate(docs.columns)))
    kept = by_document(rows, bad.select("doc_id", TEXT_HASH).distinct(), "left_anti")
    return kept.select(*((F.col("text") if c == text_col else F.col(f"__{k}")).alias(c) for k, c in enumerate(docs.columns)))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, block_words: int = 1_000_000
) -> DataFrame:
    """doc_id, text hash, n_words, n_hit, n_items, items_sha256, contaminated and spans (hit words, half-open) of every row of docs.

    A block of items has at most `block_words` words: the proven bound of each broadcast.
    """
    spark = docs.sparkSession
    source, shares = identified(docs, id_col, text_col), []
    for block in _blocks(benchmark, item_col, item_text_col, n, block_words):
        shared = share(spark, WindowSet(block, n))
        shares.append(source.mapInArrow(_scan(shared), f"{identity(source)}, n_words long, spans array<array<int>>, items array<string>"))
    if len(shares) == 1:
        found = shares[0].select("doc_id", TEXT_HASH, "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
        return found.mapInArrow(_finish, f"{identity(source)}, {_RESULT}")
    base, rest = shares[0], shares[0]
    for more in shares[1:]:
        rest = rest.unionByName(more)
    groups = rest.where(F.size("spans") > 0).groupBy("doc_id", TEXT_HASH).agg(F.collect_list("spans").alias("g_spans"), F.collect_list("items").alias("g_items"))
    joined = by_document(base.select("doc_id", TEXT_HASH, "n_words"), groups, keep=("g_spans", "g_items"))
    empty = F.array().cast
    found = joined.select(
        "doc_id", TEXT_HASH, "n_words", F.coalesce("g_spans", empty("array<array<array<int>>>")).alias("spans"), F.coalesce("g_items", empty("array<array<string>>")).alias("items")
    )
    return found.mapInArrow(_finish, f"{identity(source)}, {_RESULT}")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for k in range(batch.num_rows):
            text, spans = batch.column("text")[k].as_buffer().to_pybytes(), batch.column("spans")[k].as_py()
            if spans:
                at = [m.span() for m in _WORDS.finditer(text)]
                edges = [0, *(x for s, e in spans for x in (at[s][0], at[e - 1][1])), len(text)]
                text = b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            kept.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "text"])


def remove_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text of every row of docs, without the words that are benchmark text and what stands between those of a passage."""
    hit = contamination(docs, benchmark, id_col, text_col, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", TEXT_HASH])
    joined = by_document(identified(docs, id_col, text_col), hit, keep=("spans",))
    return joined.select("doc_id", "text", "spans").mapInArrow(_without, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, text string")


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"
