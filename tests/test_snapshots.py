"""Laid-out tables of the queries grow in files, not in rows a file; a new snapshot takes one join."""

from docloom.plans import relational


def test_files_follow_the_partitions_that_rows_need(spark):
    put = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        table = relational._table(spark, spark.range(2400), "grown", "id")
        assert table.index().count() == 24 and table.read().count() == 2400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
