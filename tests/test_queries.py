"""Every query against its SQL, and what the registry promises."""

from __future__ import annotations

import pytest

import quorumspark.plans  # noqa: F401
from quorumspark.registry import REGISTRY
from tests.oracle import rows_of_spark, rows_of_sql

WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql)
#: SQL cannot say these; test_text.py holds them against a re-statement.
WITHOUT_SQL = {"text_to_html", "alternative_standards"}


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, data, name):
    q = REGISTRY[name]
    assert rows_of_spark(q.run(spark, data)) == rows_of_sql(q.sql, data)


def test_only_known_queries_lack_sql():
    assert {n for n, q in REGISTRY.items() if not q.sql} == WITHOUT_SQL


def test_every_operator_of_the_inventory_is_covered():
    covered = {x for q in REGISTRY.values() for x in q.covers}
    wanted = {f"FL{i}" for i in range(1, 31)} | {f"PR{i}" for i in range(1, 17)} | {f"AG{i}" for i in range(1, 36)} | {f"JN{i}" for i in range(1, 16)}
    wanted |= {f"ST{i}" for i in range(1, 11)} | {f"WN{i}" for i in range(1, 10)} | {f"TX{i}" for i in range(1, 22)} | {f"SM{i}" for i in (*range(1, 9), 11, 12, 13)}
    wanted |= {f"SC{i}" for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {f"SK{i}" for i in (*range(1, 13), *range(14, 19))} | {"AG5b", "AG5c", "AG5d", "AG5e", "ST7b"}
    assert wanted <= covered, sorted(wanted - covered)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
