"""Snapshot tables: pruned lookups, replacement in one commit, conflicts, roll-back."""

import threading

import pytest
from pyspark.sql import functions as F

from docloom.sources.tables import MOST_VALUES, Conflict, SnapshotTable, Withdrawn


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t")


def rows(spark, n=4000, mark=0):
    return spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 40).alias("owner_id"), "id", F.lit(mark).alias("mark"))


def test_a_lookup_reads_few_files(spark, table):
    table.replace(rows(spark), "owner_id", "id", files=20)
    found = table.lookup(owner_id="u7")
    assert len(found.inputFiles()) <= 3 and table.read().inputFiles().__len__() == 20
    assert sorted(r["id"] for r in found.collect()) == list(range(7, 4000, 40))
    both = table.lookup(owner_id=["u7", "u39", "none"], id=[7, 8, 39])
    assert {(r["owner_id"], r["id"]) for r in both.collect()} == {("u7", 7), ("u39", 39)}
    assert len(both.inputFiles()) <= 4
    assert table.lookup(owner_id="zz").count() == table.lookup(owner_id=[]).count() == 0
    with pytest.raises(ValueError):
        table.lookup(mark=0)
    with pytest.raises(ValueError):
        table.lookup(id=list(range(MOST_VALUES + 1)))


def test_a_hot_owner_fills_several_files(spark, table):
    table.replace(rows(spark).withColumn("owner_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("owner_id"))), "owner_id", "id", files=12)
    index = table.index().where("least_owner_id <= 'hot' and most_owner_id >= 'hot'").collect()
    assert len(index) >= 4 and max(r["n"] for r in table.index().collect()) < 800
    one = table.lookup(owner_id="hot", id=300)
    assert one.count() == 1 and len(one.inputFiles()) < len(index)


def test_of_two_writers_one_is_refused(spark, table):
    table.replace(rows(spark, 10), "id")
    assert table.replace(rows(spark, 10, 1), "id", base=1) == 2
    with pytest.raises(Conflict):
        table.replace(rows(spark, 10, 2), "id", base=1)
    assert table.version() == 2 and {r["mark"] for r in table.read().collect()} == {1}


def test_writers_at_once_leave_one_winner_each_version(spark, table):
    table.replace(rows(spark, 10), "id")
    ends = []

    def write(mark):
        try:
            ends.append(SnapshotTable(spark, table.path).replace(rows(spark, 10, mark), "id", base=1))
        except Conflict:
            ends.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(ends, key=str) == [2, None, None] and table.versions() == [1, 2]
    assert table.read().count() == 10


def test_readers_never_see_half_a_replacement(spark, table):
    table.replace(rows(spark, 500), "id", files=4)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(tuple(table.read().agg(F.count(F.lit(1)), F.countDistinct("mark")).first()))

    reader = threading.Thread(target=read)
    reader.start()
    for mark in range(1, 4):
        table.replace(rows(spark, 500, mark), "id", files=4)
    stop.set()
    reader.join()
    assert seen and set(seen) == {(500, 1)}


def test_a_withdrawn_run_leaves_nothing(spark, table, tmp_path):
    table.replace(rows(spark, 5), "id")
    with pytest.raises(Withdrawn):
        table.replace(rows(spark, 5, 9), "id", check=lambda: False)
    with pytest.raises(ZeroDivisionError):
        table.replace(rows(spark, 5, 9), "id", check=lambda: 1 / 0)
    assert table.version() == 1 and len(list((tmp_path / "t").glob("snapshot-*"))) == 1


def test_roll_back_and_vacuum(spark, table, tmp_path):
    for mark in range(3):
        table.replace(rows(spark, 5, mark), "id")
    assert table.roll_back(1) == 4 and {r["mark"] for r in table.read().collect()} == {0}
    table.vacuum(keep=2)
    assert table.versions() == [3, 4] and len(list((tmp_path / "t").glob("snapshot-*"))) == 2
    assert {r["mark"] for r in table.read(3).collect()} == {2} and {r["mark"] for r in table.read().collect()} == {0}


def test_an_empty_table_and_null_keys(spark, table):
    table.replace(rows(spark, 0), "owner_id", "id")
    assert table.read().count() == table.lookup(owner_id="u1").count() == 0
    table.replace(spark.createDataFrame([(None, 1), ("a", 2)], "owner_id string, id long"), "owner_id")
    assert [r["id"] for r in table.lookup(owner_id="a").collect()] == [2] and table.read().count() == 2
