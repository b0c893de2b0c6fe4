"""Statuses of a stream: however events are dealt out to batches, documents end as if all had come in order."""

import json
import random

import pytest

from docloom.operators import review
from docloom.plans.adapters import view
from docloom.plans.relational import status_transitions
from docloom.schemas import TRANSITIONS
from docloom.streaming import ingest

from .conftest import SMALL

FIELDS = ["document_id", "seq", "target", "page_rows", "page_count", "has_started", "has_timing"]
COLUMNS = ["document_id", "status", "n_accepted", "n_rejected"]


def events(documents, each, seed):
    """Walks over the status graph with gaps, ties, repeated rows, nulls and targets that aren't allowed."""
    rng, rows = random.Random(seed), []
    for document in range(documents):
        status, seq = "PENDING", rng.randrange(5)
        for _ in range(each):
            target = rng.choice(TRANSITIONS[status]) if rng.random() < 0.8 else rng.choice([*TRANSITIONS, " queued ", "NONE", None, ""])
            n = rng.choice([0, 1, 2, None])
            row = (document, rng.choice([seq, seq, seq, None]), target, n, rng.choice([n, 1]), rng.choice([True, True, None, False]), rng.choice([True, True, None]))
            rows += [row] * rng.choice([1, 1, 1, 2])
            status = target if target in TRANSITIONS else status
            seq += rng.randrange(3)
    return rows


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, r))) for r in rows))


def played(spark, tmp_path, name, batches, **options):
    """The statuses after a run of the stream for each batch, the checkpoint carrying over."""
    folder = tmp_path / f"{name}-in"
    for k, rows in enumerate(batches):
        put(folder, k, rows)
        ingest.run_status(spark, str(folder), str(tmp_path / name), str(tmp_path / f"{name}-cp"), **options).awaitTermination(120)
    return ingest.current_status(spark, str(tmp_path / name))


def rows_of(df, columns=COLUMNS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("order", ["as they came", "backwards", "shuffled"])
def test_any_batching_gives_the_same_statuses(spark, tmp_path, order):
    rows = events(12, 15, 7)
    wanted = rows_of(review.fold_status(spark.createDataFrame(rows, ingest.STATUS_EVENT)))
    dealt = {"as they came": rows, "backwards": rows[::-1], "shuffled": random.Random(3).sample(rows, len(rows))}[order]
    got = played(spark, tmp_path, "s", [dealt[k::3] if order == "shuffled" else dealt[k * len(dealt) // 3:(k + 1) * len(dealt) // 3] for k in range(3)])
    assert rows_of(got) == wanted
    assert {r["n_late"] for r in got.collect()} == {0}


def test_settled_places_are_closed_and_late_events_counted(spark, tmp_path):
    row = lambda seq, target: (1, seq, target, 1, 1, True, True)
    batches = [[row(10, "QUEUED"), row(20, "PROCESSING")], [row(30, "PROCESSED"), row(25, "FAILED")], [row(9, "CANCELED"), row(None, "QUEUED"), row(27, "QUEUED"), row(40, "APPROVED")]]
    got = played(spark, tmp_path, "h", batches, horizon=10)
    # 10 is settled by the first batch's end only once 20 is more than 10 ahead, which 30 is: places up to 19 are closed then
    assert rows_of(got, [*COLUMNS, "n_late"]) == [(1, "QUEUED", 4, 2, 2)]
    open_end = played(spark, tmp_path, "o", batches)
    assert rows_of(open_end) == rows_of(review.fold_status(spark.createDataFrame(sum(batches, []), ingest.STATUS_EVENT)))


def test_a_wide_horizon_changes_nothing_and_a_negative_one_is_refused(spark, tmp_path):
    rows = [r for r in events(6, 12, 11) if r[1] is not None]
    wanted = rows_of(review.fold_status(spark.createDataFrame(rows, ingest.STATUS_EVENT)))
    got = played(spark, tmp_path, "w", [rows[1::2], rows[::2]], horizon=3 * 12 + 5)
    assert rows_of(got) == wanted
    with pytest.raises(ValueError):
        ingest.run_status(spark, str(tmp_path / "w-in"), str(tmp_path / "n"), str(tmp_path / "n-cp"), horizon=-1)


def test_the_registered_events_streamed_out_of_order(spark, tmp_path):
    """All events of the tables' status query, dealt out against their order, end as the query's rows."""
    wanted = status_transitions(spark, SMALL)
    source = tmp_path / "t"
    view(spark, SMALL, "v_status_events").repartition(4, "seq").write.json(str(source))
    ingest.run_status(spark, str(source), str(tmp_path / "t-out"), str(tmp_path / "t-cp"), files_per_batch=1).awaitTermination(300)
    assert rows_of(ingest.current_status(spark, str(tmp_path / "t-out"))) == rows_of(wanted)
