"""Where images and models come in: pluggable functions over Arrow batches.

An OCR engine is a factory of functions bytes -> list of token dicts; a predictor
is a factory of functions (tokens, boxes, document type) -> list of (label,
confidence). The factory runs once a task, so a model is loaded once. No model is
shipped here; ``stub_predictor`` is deterministic and needs nothing, and
``region_engine`` finds where words are but can't read them.
"""

from __future__ import annotations

import hashlib
import importlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.folds import fold_blocks, starts_of
from ..operators.tokens import MODEL_TOKENS, chunk_sizes

_TOKEN = "token string, x0 int, y0 int, x1 int, y1 int, conf_pct double, block_num int, paragraph_num int, line_num int, word_num int"


def extract_tokens(images: DataFrame, engine: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """document, page_number, token_index and the engine's token columns for each image (see ``read_images``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = engine()
        for batch in batches:
            out = []
            for doc, page, data in zip(batch.column("document").to_pylist(), batch.column("page_number").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out += [{"document": doc, "page_number": page, "token_index": k, **t} for k, t in enumerate(read(data))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    text, number = pa.string(), pa.int32()
    names = ("x0", "y0", "x1", "y1")
    schema = pa.schema([("document", text), ("page_number", number), ("token_index", number), ("token", text), *[(n, number) for n in names], ("conf_pct", pa.float64()), *[(n, number) for n in ("block_num", "paragraph_num", "line_num", "word_num")]])
    return images.select("document", "page_number", "content").mapInArrow(rows, f"document string, page_number int, token_index int, {_TOKEN}")


def predict_pages(pages: DataFrame, predictor: Callable[[], Callable]) -> DataFrame:
    """page_id, chunk_start, local_index, token, label, confidence of page chunks (page_id, chunk_start, document_type, tokens, bboxes)."""
    schema = pa.schema([("page_id", pa.int64()), ("chunk_start", pa.int32()), ("local_index", pa.int32()), ("sub_index", pa.int32()), ("token", pa.string()), ("label", pa.string()), ("confidence", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                found = predict(x["tokens"], x["bboxes"], x["document_type"])
                out += [{"page_id": x["page_id"], "chunk_start": x["chunk_start"], "local_index": k, "sub_index": 0, "token": t, "label": label, "confidence": c} for k, (t, (label, c)) in enumerate(zip(x["tokens"], found, strict=True))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pages.select("page_id", "chunk_start", "document_type", "tokens", "bboxes").mapInArrow(rows, "page_id long, chunk_start int, local_index int, sub_index int, token string, label string, confidence double")


def label_pages(tokens: DataFrame, predictor: Callable[[], Callable], page: str = "page_id", model_tokens: int = MODEL_TOKENS, unlabelled: str = "hitl", dealt: bool = False) -> DataFrame:
    """page, token_index, label, confidence of every token: pages through the predictor in overlapping chunks, stitched and filled by the task that read them.

    tokens: page, token_index, token, x0..y1, document_type. Results are as of ``chunk_ranges``, ``predict_pages``, ``stitch`` and ``fill_gaps``, positions being
    counted along a page's token_index, but predictions aren't shuffled and joined again. dealt: a page's tokens share a partition already.
    """
    size, overlap = chunk_sizes(model_tokens)
    stride = max(1, size - overlap)

    def rank(confidence: float | None) -> tuple:
        return (confidence is not None, confidence != confidence, confidence)

    def labels():
        predict = predictor()

        def step(block: pa.RecordBatch, last: bool) -> tuple[list, int]:
            ends = np.append(np.flatnonzero(starts_of(block, [page])), block.num_rows).tolist()
            if not last:
                ends.pop()
            words, kind = (block.column(c).to_pylist() for c in ("token", "document_type"))
            boxes = [list(b) for b in zip(*(block.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True)]
            out: list[tuple] = []
            for s, e in zip(ends, ends[1:], strict=False):
                for c in range(s, max(s, s + math.ceil((e - s - size) / stride) * stride) + 1, stride):
                    to = min(e, c + size)
                    found = [p for _, p in zip(words[c:to], predict(words[c:to], boxes[c:to], kind[s]), strict=True)]
                    again = len(out) - c
                    out[c:] = [b if rank(b[1]) > rank(a[1]) else a for a, b in zip(out[c:], found[:again], strict=True)]
                    out += found[again:]
            done = block.slice(0, len(out))
            return [done.column(page), done.column("token_index"), pa.array([unlabelled if x is None else x for x, _ in out], pa.string()), pa.array([0.0 if x is None else x for _, x in out], pa.float64())], len(out)

        return step

    rows = tokens.select(page, "token_index", "token", "x0", "y0", "x1", "y1", "document_type")
    return fold_blocks(rows, [page], ["token_index", "token"], labels, f"token_index {dict(rows.dtypes)['token_index']}, label string, confidence double", dealt)


def stub_predictor(labels: tuple[str, ...] = ("O", "name", "date", "total")) -> Callable[[], Callable]:
    """Labels and confidences from a hash of the token."""

    def factory() -> Callable:
        def predict(tokens: list[str], boxes: list, document_type: str | None) -> list[tuple[str, float]]:
            codes = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in tokens]
            return [(labels[c % len(labels)], (c // 7 % 101) / 100) for c in codes]

        return predict

    return factory


def region_engine() -> Callable[[], Callable[[bytes], list[dict]]]:
    """Tokens of confidence 0 for the dark regions of a PNG page."""

    def factory() -> Callable[[bytes], list[dict]]:
        from ..functions.images import fallback_tokens
        from .pages import png_pages

        return lambda data: fallback_tokens(png_pages(data)[0])

    return factory


#: The two that need nothing, by name (see ``named_factory``).
region_factory, stub_factory = region_engine(), stub_predictor()


def named_factory(name: str) -> Callable:
    """The factory that `module:attribute` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)
