"""Every registered query against its SQL oracle on the smallest tables."""

import check
import pytest
from support import SF

import __spark_entry__ as E
from pagequarry.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note, _ = check.compare(spark, con, name, SF)
    assert ok is not False, note


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(E.queries())


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["url", "email", "logo", "business_name", "services", "error"]
    assert df.count() > 0
