"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import connect, rows_of_frame, rows_of_sql
from tests.conftest import DATA


def _names():
    from lexmill.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from lexmill.plans import registry

    frame = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        rows = frame.collect()  # all columns are computed; count() would prune them
        assert len(rows) == len({tuple(map(str, r)) for r in rows}) or name in ("search_snippets",)
    else:
        assert rows_of_frame(frame) == rows_of_sql(connect(DATA), sql, frame.columns)


def test_partitioning_does_not_matter(spark):
    from lexmill.operators import ledger

    payloads = spark.read.parquet(f"{DATA}/payloads.parquet")
    one, many = (ledger.parsed(ledger.distinct_rows(payloads.repartition(n))) for n in (1, 16))
    assert rows_of_frame(one) == rows_of_frame(many)
