"""Every query with SQL against DuckDB, digit by digit, at the scale factor of the correctness check."""

import os

import duckdb
import pytest

from featstab.plans import catalogue, oracle


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf):
    with duckdb.connect() as con:
        for name in os.listdir(sf):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
        yield con


def shown(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value + 0.0:.9f}"  # both sides are rounded, so nothing is rounded here
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_every_query_but_the_model_fits_has_sql():
    only = {"model_cv_metrics", "model_rankings", "tree_support", "model_stability", "c_grid_rank_agreement", "c_grid_top_overlap", "frozen_lr_transfer", "regime_diagnostics"}
    assert set(catalogue.QUERIES) - set(oracle.QUERIES) == only and set(oracle.QUERIES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["benjamini_hochberg", "permuted_labels", "document_cohort_metrics", "gene_table_k5", "misordered_samples"])
def test_global_orders_have_no_task_of_their_own(spark, name):
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() and "SinglePartition" not in got._jdf.queryExecution().toString()
