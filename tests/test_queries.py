"""Every query of the engine's own operators against DuckDB on the same tables."""

import pytest

from eventloom import catalog

from .conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
