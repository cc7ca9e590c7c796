"""Every query with an oracle gives what DuckDB gives on the smallest data; the others give rows."""

import duckdb
import pandas as pd
import pytest

from quire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return [plain(v) for v in value]
    return str(int(value)) if isinstance(value, (bool, int)) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_matches(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_gives_rows(spark, sf, name):
    """What these rows are is told in test_operators.py and test_pages.py."""
    found = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(found) and found.notna().any(axis=0).sum() >= len(found.columns) - 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
