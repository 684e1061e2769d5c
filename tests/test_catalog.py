"""The registered queries: each has SQL or a reason not to, and the quick ones agree with it."""

import duckdb
import pytest

import __spark_entry__ as registry
from catalog.oracle import ORACLES
from catalog.queries import QUERIES
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# fitted models: not expressible in SQL, tested in test_models and test_boosting, and by the queries named ..._facts
WITHOUT_SQL = {
    "model_ridge_all_features", "model_boosted_trees", "model_boosted_quantiles", "model_quantile_forest", "point_four_models",
    "backtest_boosted",
}
SAMPLE = (
    "source_tolerant_casts", "clean_readings_full", "audit_consumption", "cohort_halfhour_load", "split_counts",
    "feature_table", "model_ridge_two_features", "conformal_static", "conformal_aci", "conformal_shift_aware",
    "shift_two_sample_large_groups", "conditional_reliability", "bootstrap_suppliers", "ablation_gamma_rates",
    "stream_cohort_load",
)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    result = sql.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_flagship(spark):
    assert registry.entry(spark).count() == 18
