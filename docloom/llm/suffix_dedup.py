"""Repeated byte strings of at least `length` bytes, removed wherever they occur, and shorter repeated passages, reported.

Sampling. Of the k-grams in each window of `length` bytes the one with the
smallest hash (the leftmost of equals) is the window's anchor, so equal windows
have equal anchors at the same place. An anchor's windows start in a range
[a, b]; its context is the bytes from a to b + length. Every window belongs to
one anchor, so windows need only be compared within an anchor's group.

Contexts that are equal as a whole are found first, by streaming the anchors in
sorted, range-partitioned order (a passage in a third of all documents fills as
many partitions as it needs); these occurrences are done, and one of them stays
to be compared with the anchor's other contexts.

Where an anchor has several contexts, an enhanced suffix array over its
occurrences (sorted right-hand sides with common-prefix lengths) is scanned with
a stack, which gives its common-prefix interval tree: each node is a set of
occurrences that share so many bytes to the right. Its members are ordered by
their left-hand sides; runs with enough common bytes on the left, and different
next bytes on both sides, are the maximal repeat groups with all their
occurrences, and what is removed is what these cover.

A group of more than `GROUP` contexts is first dealt out: a window `d` bytes
left of its anchor lies in one of four parts of the possible range of d, and the
windows of a part share a core of bytes, whose hash is the new group. A context
goes there cut to the windows of the part, and those that are equal then are
settled by streaming as before, so that many copies that differ elsewhere are one.
This goes on until groups are small; where the range is one window, all are equal.
No task holds more than `GROUP` contexts, and no occurrence is left out.

Shorter passages. Where `passage` is less than `length`, strings of `passage` bytes
are sought first; a longer one can only lie in a run that these cover, so that
`length` is sought within runs of so many bytes alone. A passage is such a run
with `passage_words` whole words or more; passages are reported, not removed.

Defined results: null and empty texts, and texts under `length` bytes, lose
nothing; matches may overlap themselves; repeated rows are one document (see
``common``), so they don't match each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_HASH, by_document, identified, identity, release, shuffle_parts, stored, text_runs

GRAM, GROUP, PARTS = 32, 256, 4
_PLACE = 24  # bits of a position within a segment; longer texts are cut into segments
_SEGMENT = 1 << 20
_U64 = np.uint64
_ROW = ["h", "c1", "c2", "doc_id", TEXT_HASH, "a", "b", "p"]
_SPAN = ["doc_id", TEXT_HASH, "s", "e", "repeat"]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` bytes (a power of two), by doubling."""
    x, width = data.astype(_U64) + _U64(1), 1
    while width < gram:
        x = x[:-width] * _U64(0x9E3779B97F4A7C15 * (2 * width + 1) % 2**64) + (x[width:] ^ (x[width:] >> _U64(29)))
        width *= 2
    x = (x ^ (x >> _U64(32))) * _U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U64(32))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(text: bytes | memoryview, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, a, b, p): the windows that start in [a, b] have their anchor at p. An anchor beside a segment's end is given once, with its whole range."""
    held: tuple[int, int, int, int] | None = None
    for base in range(0, max(1, len(text) - length + 1), _SEGMENT):
        data = np.frombuffer(text, dtype=np.uint8, offset=base, count=min(len(text) - base, _SEGMENT + length - 1))
        if len(data) < length:
            break
        hashes = gram_hashes(data)
        placed = hashes >> _U64(_PLACE) << _U64(_PLACE) | np.arange(len(hashes), dtype=_U64)
        at = (window_least(placed, length - GRAM + 1) & _U64(2**_PLACE - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        p = at[first]
        for h, a, b, place in zip(hashes[p].view("i8").tolist(), (first + base).tolist(), (last + base).tolist(), (p + base).tolist(), strict=True):
            if held is not None and held[3] == place:
                held = (h, held[1], b, place)
                continue
            if held is not None:
                yield held
            held = (h, a, b, place)
    if held is not None:
        yield held


def _anchor_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_runs(whole):
                ids, hashes, texts = batch.column("doc_id").to_pylist(), batch.column(TEXT_HASH).to_pylist(), batch.column("text")
                within = batch.column("within") if "within" in batch.schema.names else None
                found, owner, digests = [], [], []
                for k in range(batch.num_rows):
                    text = texts[k].as_buffer().to_pybytes()
                    if len(text) < length:
                        continue
                    view, n = memoryview(text), len(found)
                    for s, e in [(0, len(text))] if within is None else within[k].as_py():
                        found += [(h, s + a, s + b, s + p) for h, a, b, p in anchors(view[s:e], length)]
                    # the anchor's place counts too: equal bytes with another range of windows are another context
                    digests += [xxhash.xxh3_128_digest(view[a : b + length], seed=p - a) for _, a, b, p in found[n:]]
                    owner += [k] * (len(found) - n)
                halves = np.frombuffer(b"".join(digests), dtype=">i8").astype("i8").reshape(-1, 2)
                h, a, b, p = np.array(found, dtype=np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([ids[k] for k in owner], batch.column("doc_id").type), pa.array([hashes[k] for k in owner], pa.int64())]
                    + [pa.array(x.astype(np.int32)) for x in (a, b, p)],
                    _ROW,
                )

    return rows


DONE, COMPARE, OPEN, EDGE = 0, 1, 2, 3


def _sort_out(more: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of anchors sorted by (h, context): occurrences whose context occurs again (DONE), and one of each context to COMPARE where h has several.

    A context's run at the partition's edge may go on next door: it leaves its count (EDGE), and a single occurrence stays OPEN.
    more: further columns, which rows to COMPARE keep.
    """
    names = [*_ROW, *more]

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "n", *names])
            out.clear()
            return batch

        gram = context = row = seen = None
        n, first_context, first_gram, lead = 0, True, True, None
        width, nothing = len(_ROW) - 3, (None,) * len(more)

        def close_context(edge: bool) -> None:
            if edge and context is not None:
                out.append((EDGE, n, gram, *context, *[None] * width, *nothing))
                if n == 1:
                    out.append((OPEN, None, gram, *context, *row[:width], *nothing))

        def close_gram(edge: bool) -> None:
            if edge and lead is not None:  # h may have other contexts next door
                out.append((COMPARE, None, *lead))

        for batch in batches:
            types = types or [pa.int32(), pa.int32(), *(batch.column(x).type for x in names)]
            for h, c1, c2, *rest in zip(*[batch.column(x).to_pylist() for x in names], strict=True):
                if h != gram or (c1, c2) != context:
                    close_context(first_context)
                    first_context = first_context and context is None
                    if h != gram:
                        close_gram(first_gram)
                        first_gram = first_gram and gram is None
                        lead = (h, c1, c2, *rest)
                    else:
                        if lead is not None:
                            out.append((COMPARE, None, *lead))
                            lead = None
                        out.append((COMPARE, None, h, c1, c2, *rest))
                    gram, context, n, row, seen = h, (c1, c2), 0, rest, None
                if rest == seen:
                    continue  # a repeated row
                seen, n = rest, n + 1
                if n == 2:
                    out.append((DONE, None, h, c1, c2, *row[:width], *nothing))
                if n >= 2:
                    out.append((DONE, None, h, c1, c2, *rest[:width], *nothing))
                if len(out) > 5000:
                    yield flush()
        close_context(True)
        close_gram(True)
        if out:
            yield flush()

    return sort_out


def _contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "lo", "hi", "doc_id", TEXT_HASH, "a", "p", "context"]
        for batch in batches:
            types = [pa.int64(), pa.int32(), pa.int32(), batch.column("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            out = []
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer().to_pybytes()
                doc, text_hash = batch.column("doc_id")[k].as_py(), batch.column(TEXT_HASH)[k].as_py()
                for x in batch.column("at")[k].as_py():
                    out.append((x["h"], 0, length - GRAM, doc, text_hash, x["a"], x["p"], text[x["a"] : x["b"] + length]))
            for k in range(0, max(1, len(out)), 5000):
                columns = list(zip(*out[k : k + 5000], strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows


_MORE = ("lo", "hi", "context")


def _deal(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each context, cut, once for each part of its group's range that any of its windows lies in, under the hash of the part's core."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kind = whole.column("doc_id").type
            types = [*[pa.int64()] * 3, kind, pa.int64(), *[pa.int32()] * 5, pa.binary()]
            for at in range(0, whole.num_rows, 1000):
                out = []
                for key, lo, hi, doc, text_hash, a, p, context in zip(*[c.to_pylist() for c in whole.slice(at, 1000).columns], strict=True):
                    b, edges = a + len(context) - length, [lo + (hi + 1 - lo) * k // PARTS for k in range(PARTS + 1)]
                    for x, y in zip(edges, edges[1:], strict=False):
                        y -= 1
                        if x <= y and x <= p - a and y >= p - b:
                            first, last = max(a, p - y), min(b, p - x)
                            core, cut = context[p - x - a : p + length - y - a], context[first - a : last + length - a]
                            c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(cut, seed=p - first), dtype=">i8").tolist()
                            out.append((xxhash.xxh3_64_intdigest(core + b"%d %d %d" % (key, x, y)) - 2**63, c1, c2, doc, text_hash, first, last, p, x, y, cut))
                columns = list(zip(*out, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_ROW, *_MORE])

    return rows


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(x), len(y))
    if x[:most] == y[:most]:
        return most
    low = 0
    while most - low > 1:
        middle = (low + most) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            most = middle
    return low


def prefix_intervals(lengths: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree of a suffix array, children first: (length, first, last). lengths[k] belongs to places k and k + 1."""
    stack: list[tuple[int, int]] = []
    for k, n in enumerate([*lengths, -1]):
        first = k
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield length, first, k
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, first))


def _tree_nodes(rows: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Nodes of the interval tree that may hold a repeat: (common bytes right, members by left-hand side, common bytes left of neighbours)."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][1])
    lengths = [common(rows[x][1], rows[y][1]) for x, y in zip(order, order[1:], strict=False)]
    by_left = {k: place for place, k in enumerate(sorted(range(len(rows)), key=lambda k: rows[k][0]))}
    most_left, known = max(len(left) for left, _ in rows), {}
    for right, first, last in prefix_intervals(lengths):
        if right + most_left < length:
            continue
        members = sorted(order[first : last + 1], key=by_left.__getitem__)
        lefts = []
        for pair in zip(members, members[1:], strict=False):
            if pair not in known:
                known[pair] = common(rows[pair[0]][0], rows[pair[1]][0])
            lefts.append(known[pair])
        yield right, members, lefts


def repeat_groups(rows: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats among occurrences given as (left-hand side reversed, right-hand side).

    Gives (bytes left, bytes right, occurrences): all occurrences that share as much, where that is `length` bytes at least.
    The runs over left-hand sides differ in their next byte to the left; a run that goes on alike to the right is a child's.
    """
    for right, members, lefts in _tree_nodes(rows, length):
        for left, start, end in prefix_intervals(lefts):
            if left + right >= length:
                group = members[start : end + 1]
                following = {rows[k][1][right : right + 1] for k in group}
                if len(following) > 1 or b"" in following:
                    yield left, right, group


def united(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Disjoint half-open spans that don't touch, in order."""
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return joined


def _compare(length: int, groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of the maximal repeat groups among each key's contexts: united for each occurrence or, with groups, each under its string's hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, kind = None, [], [], pa.int64()

        def flush() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.int32(), pa.int32(), pa.int64())[: 4 + groups]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _SPAN[: 4 + groups])
            out.clear()
            return batch

        def close() -> None:
            rows = list({(doc, text_hash, p): (doc, text_hash, a, p, context) for doc, text_hash, a, p, context in held}.values())  # repeated rows are one document
            if len(rows) < 2:
                return
            spans: dict[int, set[tuple[int, int]]] = {}
            for left, right, group in repeat_groups([(c[: p - a][::-1], c[p - a :]) for _, _, a, p, c in rows], length):
                if groups:
                    _, _, a, p, context = rows[group[0]]
                    repeat = xxhash.xxh3_64_intdigest(context[p - a - left : p - a + right]) - 2**63
                    out.extend((*rows[k][:2], rows[k][3] - left, rows[k][3] + right, repeat) for k in group)
                else:
                    for k in group:
                        spans.setdefault(k, set()).add((rows[k][3] - left, rows[k][3] + right))
            out.extend((rows[k][0], rows[k][1], s, e) for k, found in spans.items() for s, e in united(found))

        for batch in batches:
            kind = batch.column("doc_id").type
            for new, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "doc_id", TEXT_HASH, "a", "p", "context")], strict=True):
                if new != key:
                    close()
                    key, held = new, []
                    if len(out) > 5000:
                        yield flush()
                held.append(row)
        close()
        if out:
            yield flush()

    return rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, within: DataFrame | None = None, groups: bool = False) -> DataFrame:
    """doc_id, text hash, s and e (bytes, half-open, may overlap) of strings of `length` bytes or more that also start elsewhere.

    groups: one row for each repeat group an occurrence is in, with `repeat`, the group's number, which rows of equal strings
    share. Occurrences whose contexts are equal as a whole are a group of their own, a class, and one of them stands for the
    class in groups with other contexts; so a group's occurrences are its rows and those of the classes that these stand for.

    within: doc_id, text hash and within (array of [s, e]); if given, only these runs of these documents are looked at.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    docs = identified(docs, id_col, text_col)
    parts, ident = shuffle_parts(docs.sparkSession), identity(docs)
    anchor_row, context_row = f"h long, c1 long, c2 long, {ident}, a int, b int, p int", f"key long, lo int, hi int, {ident}, a int, p int, context binary"
    if within is not None:
        docs = by_document(docs, within, "inner", keep=("within",))

    def settled(rows: DataFrame, kind: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """Spans of contexts that are equal as a whole, and the stored table with one of each context to compare."""
        order = ["h", "c1", "c2", "doc_id", TEXT_HASH, "a"]
        rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = stored(rows.mapInArrow(_sort_out(more), f"kind int, n int, {kind}"), "sorted")
        again = found.where(F.col("kind") == EDGE).groupBy("h", "c1", "c2").agg(F.sum("n").alias("n")).where("n > 1").select("h", "c1", "c2")
        done = found.where(F.col("kind") == DONE).unionByName(found.where(F.col("kind") == OPEN).join(again, ["h", "c1", "c2"], "left_semi").select(*found.columns))
        repeat = [F.xxhash64("h", "c1", "c2").alias("repeat")] if groups else []
        return done.select("doc_id", TEXT_HASH, F.col("a").alias("s"), (F.col("b") + length).alias("e"), *repeat), found

    anchored = stored(docs.mapInArrow(_anchor_rows(length), anchor_row), "anchors")
    spans, found = settled(anchored, anchor_row)
    release(anchored)

    at = found.where(F.col("kind") == COMPARE).groupBy("doc_id", TEXT_HASH).agg(F.collect_list(F.struct("h", "a", "b", "p")).alias("at"))
    texts = by_document(docs, at, "inner", keep=("at",))
    contexts = stored(texts.select("doc_id", TEXT_HASH, "text", "at").mapInArrow(_contexts(length), context_row), "contexts")
    small, tables = [], [found, contexts]
    while True:
        large = stored(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP).select("key"), "large")
        tables.append(large)
        if large.isEmpty():
            small.append(contexts)
            break
        small.append(contexts.join(large, "key", "left_anti").select(*contexts.columns))
        hot = contexts.join(large, "key", "left_semi").select(*contexts.columns)
        dealt_row = f"{anchor_row}, lo int, hi int, context binary"
        dealt = stored(hot.mapInArrow(_deal(length), dealt_row), "dealt")
        more, found = settled(dealt, dealt_row, _MORE)
        release(dealt)
        tables.append(found)
        spans = spans.unionByName(more)
        contexts = found.where(F.col("kind") == COMPARE).select(F.col("h").alias("key"), "lo", "hi", "doc_id", TEXT_HASH, "a", "p", "context")
    pile = small[0]
    for more in small[1:]:
        pile = pile.unionByName(more)
    grouped = pile.repartition(parts, "key").sortWithinPartitions("key")
    spans = stored(spans.unionByName(grouped.mapInArrow(_compare(length, groups), f"{ident}, s int, e int" + (", repeat long" if groups else ""))), "spans")
    release(*tables)
    return spans


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words (runs of anything but ASCII white space) of data that lie within [start, end)."""
    words = data[start:end].split()
    n = len(words)
    if n and start and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace():
        n -= 1
    if n and end < len(data) and not data[end - 1 : end].isspace() and not data[end : end + 1].isspace():
        n -= 1
    return n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """found (spans of one document) as disjoint runs."""
    for batch in batches:
        runs = [united([(y["s"], y["e"]) for y in x]) for x in batch.column("found").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(TEXT_HASH), pa.array(runs, pa.list_(pa.list_(pa.int32())))], ["doc_id", TEXT_HASH, "runs"])


def runs_of(spans: DataFrame) -> DataFrame:
    """doc_id, text hash and runs: the spans of each document, united."""
    found = spans.groupBy("doc_id", TEXT_HASH).agg(F.collect_list(F.struct("s", "e")).alias("found"))
    return found.mapInArrow(_runs, f"{identity(spans)}, runs array<array<int>>")


def _cut(passage_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            n_bytes, spans, passages, kept = [], [], [], []
            for k in range(batch.num_rows):
                data = batch.column("text")[k].as_buffer().to_pybytes()
                gone = batch.column("long")[k].as_py() or []
                edges = [0, *(y for x in gone for y in x), len(data)]
                n_bytes.append(len(data))
                spans.append(gone)
                passages.append([x for x in batch.column("short")[k].as_py() or () if whole_words(data, *x) >= passage_words])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(passages, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "passages", "kept"],
            )

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None, passage_words: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, half-open), passages (runs of repeated strings of `passage` bytes, default `length`, with so many words or more) and kept (the other bytes; perhaps no longer UTF-8) of every row of docs."""
    passage = min(passage or length, length)
    found = runs_of(repeated_spans(docs, id_col, text_col, passage)).withColumnRenamed("runs", "short")
    if passage < length:
        found = stored(found, "runs")
        within = found.select("doc_id", TEXT_HASH, F.filter("short", lambda x: F.get(x, F.lit(1)) - F.get(x, F.lit(0)) >= length).alias("within")).where(F.size("within") > 0)
        long = runs_of(repeated_spans(docs, id_col, text_col, length, within)).withColumnRenamed("runs", "long")
        found = by_document(found, long, keep=("long",))
    else:
        found = found.withColumn("long", F.col("short"))
    rows = identified(docs, id_col, text_col)
    joined = by_document(rows, found, keep=("short", "long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "short", "long").mapInArrow(_cut(passage_words), f"doc_id {id_type}, n_bytes long, spans array<array<int>>, passages array<array<int>>, kept binary")
