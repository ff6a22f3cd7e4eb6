"""Plan-shape checks: predicates reach the scan, no Cartesian joins, no
window over a whole tab."""

import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NO_PAIRS = ["CartesianProduct", "BroadcastNestedLoopJoin"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_filters_reach_the_scan(spark):
    """Typed IN and tab predicates, and the outcome of the probes, are pushed."""
    spec = dict(E.MAIN, filters={"DATA_YR": ["1996", 1997.0], "PRI": ["5-LOW"]})
    txt = plan_text(E.filters.rows_of_tab(E._xt(spark, SF, spec).filtered, "DATA_YR", "1996"))
    pushed = " ".join(l for l in txt.splitlines() if l.startswith("PushedFilters"))
    assert "In(DATA_YR, [1996,1997])" in pushed and "EqualTo(DATA_YR,1996)" in pushed and "IsNotNull(COUNTY)" in pushed, pushed
    probed = plan_text(E._xt(spark, SF, E.PROBED).filtered)
    assert "IsNull(PRI)" in probed


def test_lazy_probe_is_one_filtered_scan(spark):
    txt = plan_text(E.queries()["smart_filter_lazy"](spark, SF))
    assert "In(SEG, [BUILDING,FURNITURE])" in txt
    for op in NO_PAIRS:
        assert op not in txt


@pytest.mark.parametrize("name", ["crosstab_pct", "crosstab_2x2", "crosstab_nocols", "heat_scale", "growth_rows",
                                  "weighted_avg", "mix_report", "preset_table_1", "lineitem_crosstab",
                                  "events_crosstab", "events_weighted_avg", "report_cells"])
def test_no_pairwise_joins(spark, name):
    txt = plan_text(E.queries()[name](spark, SF))
    for op in NO_PAIRS:
        assert op not in txt, f"{name} plans a {op}"


@pytest.mark.parametrize("name", ["crosstab_pct", "crosstab_2x2", "heat_scale", "preset_table_1"])
def test_percentages_need_no_window(spark, name):
    txt = plan_text(E.queries()[name](spark, SF))
    assert "Window" not in txt


def test_cube_expands_leaf_cells_only(spark):
    """One shuffle of the facts; the grouping sets expand what it yields."""
    lines = plan_text(E.queries()["cube_build"](spark, SF)).split("\n\n")[0].splitlines()
    expand = next(i for i, l in enumerate(lines) if "Expand" in l)
    below = [l for l in lines[expand + 1:] if "HashAggregate" in l]
    assert len(below) >= 2, lines


def test_scans_read_only_needed_columns(spark):
    txt = plan_text(E.queries()["cube_build"](spark, SF))
    schemas = [l for l in txt.splitlines() if l.startswith("ReadSchema")]
    assert any("o_custkey" in s and "o_comment" not in s and s.count(":") == 5 for s in schemas), schemas
    assert any("c_custkey" in s and "c_name" not in s and "c_acctbal" not in s for s in schemas), schemas
    li = plan_text(E.queries()["lineitem_crosstab"](spark, SF))
    assert all("l_extendedprice" not in l for l in li.splitlines() if l.startswith("ReadSchema")), li
