"""A queue of uploads as a file stream.

Files of JSON lines arrive in a folder; every micro-batch is validated, turned
into token rows and written under its number, so a batch that runs again
replaces itself. Documents canceled in the meantime are left out before the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import may_follow

UPLOAD = "document_id bigint, name string, media_type string, owner_id string, text string"
STATUS_EVENT = "document_id bigint, seq int, target string, page_rows int, page_count int, has_started boolean, has_timing boolean"
_EVENT = ["seq", "target", "page_rows", "page_count", "has_started", "has_timing"]
_STATUS = "status string, n_accepted long, n_rejected long"
_KEPT = "array<struct<seq: long, target: string, page_rows: long, page_count: long, has_started: boolean, has_timing: boolean>>"
_STATE = f"{_STATUS}, n_late long, settled long, kept {_KEPT}"


def stream_uploads(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_per_batch).json(path)


def page_tokens(uploads: DataFrame) -> DataFrame:
    """Tokens of plain-text uploads: one page, lines at line feeds, words at white space. No state, so append mode suffices."""
    lines = F.transform(F.split("text", "\n"), lambda line, k: F.transform(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w: F.struct(k.alias("line_num"), w.alias("token"))))
    return uploads.select("document_id", F.posexplode(F.flatten(lines)).alias("token_index", "t")).select("document_id", "token_index", "t.line_num", "t.token")


def run_ingest(uploads: DataFrame, sink: str, checkpoint: str, canceled: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Process everything that is there, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        rows = page_tokens(batch)
        if canceled is not None:  # read again for each batch: cancellation is seen until just before the sink
            rows = rows.join(canceled().select("document_id"), "document_id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _plain(row: tuple) -> tuple:
    """An event as plain values: what a null in its column made a float becomes whole again."""
    seq, target, rows, count, started, timing = (None if pd.isna(v) else v for v in row)
    whole, flag = (lambda v: None if v is None else int(v)), (lambda v: None if v is None else bool(v))
    return whole(seq), None if target is None else target.strip().upper(), whole(rows), whole(count), flag(started), flag(timing)


def _in_order(event: tuple) -> list[tuple]:
    return [(v is not None, v) for v in event]


def _folded(start: tuple[str, int, int], events: list[tuple]) -> tuple[str, int, int]:
    status, good, bad = start
    for _, target, *facts in events:
        taken = may_follow(status, target, *facts)
        status, good, bad = target if taken else status, good + taken, bad + (not taken)
    return status, good, bad


def run_status(spark: SparkSession, events: str, sink: str, checkpoint: str, horizon: int | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """After each micro-batch the status of every document with new events, as if all of them so far had come in order of `seq`.

    State holds a document's events in order, so one that arrives late takes its place and what came after it is decided
    again: however events are dealt out to batches, the last rows are those of `review.fold_status`. A batch reads its own
    events and the state of their documents only.

    State then grows with a document's events. `horizon` bounds it: events whose `seq` is more than that behind the
    document's greatest one are settled after a batch, that is, folded and forgotten. An event that comes for a settled place (or, once
    something is settled, without a `seq`) changes nothing and is counted in `n_late`; with no horizon that count is 0.
    """
    if horizon is not None and horizon < 0:
        raise ValueError("horizon must be 0 or more")
    stream = spark.readStream.schema(STATUS_EVENT).option("maxFilesPerTrigger", files_per_batch).json(events)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, good, bad, late, settled, kept = state.get if state.exists else ("PENDING", 0, 0, 0, None, [])
        base, kept = (status, good, bad), [tuple(e) for e in kept]
        for frame in frames:
            for event in map(_plain, frame[_EVENT].astype(object).itertuples(index=False, name=None)):
                if settled is not None and (event[0] is None or event[0] <= settled):
                    late += 1
                else:
                    kept.append(event)
        kept.sort(key=_in_order)
        if horizon is not None and kept and kept[-1][0] is not None:
            edge = kept[-1][0] - horizon - 1
            n = sum(e[0] is None or e[0] <= edge for e in kept)
            if n:
                base, kept, settled = _folded(base, kept[:n]), kept[n:], edge
        state.update((*base, late, settled, kept))
        status, good, bad = _folded(base, kept)
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "n_accepted": [good], "n_rejected": [bad], "n_late": [late]})

    now = stream.groupBy("document_id").applyInPandasWithState(fold, f"document_id long, {_STATUS}, n_late long", _STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return now.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """The last row of every document that `run_status` has written: one partial and final aggregate, no window."""
    rows = spark.read.parquet(sink)
    last = F.max_by(F.struct("status", "n_accepted", "n_rejected", "n_late"), "batch").alias("last")
    return rows.groupBy("document_id").agg(last).select("document_id", "last.*")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events of a kind in each window; state is dropped once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), kind).agg(F.count(F.lit(1)).alias("n"))
