"""Named queries (``QUERIES``) and the SQL that defines their results (``ORACLE``)."""

from . import dataflow, relational

QUERIES: dict = {**relational.QUERIES, **dataflow.QUERIES}
ORACLE: dict = {**relational.ORACLE, **dataflow.ORACLE}
