import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def plain(value):
    """A value as both engines' results compare."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "tolist"):
        value = value.tolist()
    return value if isinstance(value, (int, str, bool)) else str(value)


def same_rows(got, wanted):
    """Two pandas frames with equal columns and equal rows, in any order."""
    import pandas as pd

    def rows(df: pd.DataFrame):
        df = df[sorted(df.columns)]
        return sorted((tuple(str(plain(None if v is pd.NA else v)) for v in row) for row in df.itertuples(index=False, name=None)))

    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
