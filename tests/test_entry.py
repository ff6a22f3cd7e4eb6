"""Driver contract: entry() and each query against its DuckDB oracle."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SUBSET = ["cube_suppress", "smart_filter", "crosstab_pct", "crosstab_2x2", "weighted_avg", "growth_rows",
          "reference_totals", "mix_report", "report_notes", "preset_table_1", "masked_detail", "axis_order",
          "report_cells", "lineitem_crosstab", "catalog_enabled", "delivery_inferred", "crosstab_with_gaps", "growth_guard", "growth_summary", "preview_rows"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"value", "row_pct", "is_row_total"} <= set(df.columns)


def test_every_query_has_oracle_or_is_rows_only():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    own = {n for n in set(qs) - set(sqls) if not n.startswith("op") and n != "pipeline"}
    assert own == set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert res["status"] == "match", res


def test_cluster_profile_applies_runtime_sql_settings(spark):
    from statcube.session import CLUSTER_CONF, apply_conf

    before = spark.conf.get("spark.sql.shuffle.partitions")
    apply_conf(spark, {k: v for k, v in CLUSTER_CONF.items() if k == "spark.sql.adaptive.skewJoin.skewedPartitionFactor"})
    assert spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor") == "5"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
