"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from attrispark.plans import catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind == "f":  # a value may lie between two roundings
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=2e-4, nan_ok=True)
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all()
