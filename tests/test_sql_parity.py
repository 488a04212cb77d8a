"""Every query with SQL, against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from panelspark.plans import catalog, models

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return float(f"{v:.5f}") if math.isfinite(v) else str(v)
    return v


def table_of(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(str(tuple(plain(v) for v in row)) for row in df.astype(object).itertuples(index=False, name=None)), sorted(df.columns)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, columns = table_of(catalog.queries()[name](spark, sf).toPandas())
    want, names = table_of(duck.execute(catalog.oracle_sql()[name]).df())
    assert columns == names and got == want and got


@pytest.mark.parametrize("name", ["ridge_scores", "cfi_clusters", "cfi_schedule", "factor_returns", "factor_cov", "spec_var", "kalman_filter", "gru_embed", "beta_variants", "book_grid_choice"])
def test_model_queries_run(spark, sf, name):
    assert models.Q[name](spark, sf).count() > 0
