"""Every registered query against its SQL on the smallest tables; those without SQL have to give rows of a stable schema."""

from __future__ import annotations

import pytest
from oracle import SMALL, compare

from palimpsest.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, name):
    compare(spark, SMALL, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, SMALL).schema


def test_entry_and_registry():
    import __spark_entry__

    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
