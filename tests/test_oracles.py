"""Every surface query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from facetflow.plans.oracles import oracle_sql
from facetflow.plans.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        # a column of integers with nulls comes as floats from one side only
        out.append(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


#: Second names of one and the same query are not tried again.
DIFFERENT = sorted(n for n in oracle_sql() if n.removesuffix("_full").removeprefix("log_") not in set(oracle_sql()) - {n})


@pytest.mark.parametrize("name", DIFFERENT)
def test_query_matches_sql(spark, sf_dir, db, name):
    found, expected = queries()[name](spark, sf_dir).toPandas(), db.sql(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
