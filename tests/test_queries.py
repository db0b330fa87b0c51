"""Every query with SQL against DuckDB on the same tables; the others run and keep their schema."""

import pytest

from tests.conftest import rows_of
from tickloom.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, duck):
    found = catalogue.queries()[name](spark, sf_dir)
    if name not in ORACLES:
        assert found.count() >= 0
        return
    found, want = found.toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    for c in found.columns:  # DuckDB marks missing whole numbers apart, pandas turns them to floats
        if str(found[c].dtype) != str(want[c].dtype):
            if "datetime" in str(found[c].dtype):
                want[c] = want[c].astype(found[c].dtype)
            elif "float" in str(found[c].dtype) or "Int" in str(want[c].dtype):
                found[c], want[c] = found[c].astype(float), want[c].astype(float)
    assert rows_of(found) == rows_of(want)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r["bars"] >= 34 and r["macd_dif"] is not None for r in rows)
