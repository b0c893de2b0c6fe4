"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from docloom import plans
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(plans.QUERIES[name](spark, SMALL).toPandas(), duck.execute(plans.ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
