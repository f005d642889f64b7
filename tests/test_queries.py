from __future__ import annotations

import pytest
from oracle import connect, expected_rows, rows_of

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["slot", "event_type", "n", "total"]
    assert rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, con, name):
    result = entry.queries()[name](spark, sf_dir)
    if name not in ORACLES:
        assert result.count() > 0
        return
    columns, want = expected_rows(con, ORACLES[name])
    assert sorted(result.columns) == columns
    assert rows_of(result) == want
