"""Hand-computed fixtures (FIXTURES.md M-1 .. M-5, F-1)."""

import math

import pytest
from pyspark.sql import functions as F

from statcube.operators import crosstab as xt
from statcube.operators import growth
from statcube.operators.averages import weighted_averages
from statcube.operators.decode import decode
from statcube.operators.filters import masked_rows, smart_filter
from statcube.operators.ordering import chapter_sort_columns
from statcube.operators.reference import reference_totals
from statcube.sources.codebook import Codebook

M1 = [  # Y, A, B, CNT, DATA_STATUS
    (1, None, None, 30, "正常"), (1, "a", None, 18, "正常"), (1, "b", None, 12, "正常"),
    (1, None, "x", 20, "正常"), (1, None, "y", 10, "正常"), (1, "a", "x", 10, "正常"),
    (1, "a", "y", 8, "正常"), (1, "b", "x", 10, "正常"), (1, "b", "y", 2, "遮蔽"),
]
M1_SCHEMA = "Y long, A string, B string, CNT long, DATA_STATUS string"


@pytest.fixture(scope="module")
def m1(spark):
    return spark.createDataFrame(M1, M1_SCHEMA)


def _cells(df, rows, cols, filters=None):
    f = smart_filter(df, "Y", rows, cols, filters or {})
    return xt.with_percentages(xt.crosstab_cells(f, "Y", rows, cols, "CNT"), "Y", rows, cols)


def _by_key(cells, keys):
    return {tuple(r[k] for k in keys) + (r["is_row_total"], r["is_col_total"]): r for r in cells.collect()}


def test_m1_row_only_uses_subtotal_rows(m1):
    got = _by_key(_cells(m1, ["A"], []), ["A"])
    assert got[("a", False, False)]["value"] == 18
    assert got[("b", False, False)]["value"] == 12
    assert got[(None, True, True)]["value"] == 30


def test_m1_row_and_col(m1):
    cells = _cells(m1, ["A"], ["B"])
    got = _by_key(cells, ["A", "B"])
    assert got[("a", "x", False, False)]["value"] == 10
    assert got[("a", "y", False, False)]["value"] == 8
    assert got[("b", "y", False, False)]["value"] == 2
    assert got[(None, "x", True, False)]["value"] == 20
    assert got[(None, "y", True, False)]["value"] == 10
    assert got[(None, None, True, True)]["value"] == 30
    ax = got[("a", "x", False, False)]
    assert ax["row_pct"] == pytest.approx(10 / 18)
    assert ax["col_pct"] == pytest.approx(10 / 20)
    assert ax["total_pct"] == pytest.approx(10 / 30)
    assert masked_rows(smart_filter(m1, "Y", ["A"], ["B"], {})).count() == 1


def test_m1_filter_on_other_dim(m1):
    got = _by_key(_cells(m1, ["A"], [], {"B": ["x"]}), ["A"])
    assert got[("a", False, False)]["value"] == 10
    assert got[("b", False, False)]["value"] == 10
    assert got[(None, True, True)]["value"] == 20


def test_m1_reference_totals(m1):
    assert reference_totals(m1, "Y", ["A"], []).first()["ref_total"] == 30
    assert reference_totals(m1, "Y", ["A"], [], {"B": ["x"]}).first()["ref_total"] == 20


def test_m1_without_subtotals_sums_leaves(spark):
    df = spark.createDataFrame(M1[3:], M1_SCHEMA)
    got = _by_key(_cells(df, ["A"], []), ["A"])
    assert got[("a", False, False)]["value"] == 18
    assert got[("b", False, False)]["value"] == 12


def test_m2_growth(spark):
    data = [(2021, "a", 10), (2022, "a", 20), (2023, "a", 0), (2024, "a", 5),
            (2021, "b", 5), (2023, "b", 10), (2024, "b", 0)]
    src = spark.createDataFrame(data, "tab long, k string, value long")
    got = {(r["tab"], r["k"]): r["growth_pct"] for r in growth.series_growth(src, "tab", ["k"]).collect()}
    assert got[(2022, "a")] == pytest.approx(100.0)
    assert got[(2023, "a")] == pytest.approx(-100.0)
    assert math.isinf(got[(2024, "a")])
    assert got[(2022, "b")] == pytest.approx(0.0)
    assert got[(2023, "b")] == pytest.approx(100.0)
    assert got[(2024, "b")] == pytest.approx(-100.0)
    assert 2021 not in {t for t, _ in got}
    totals = spark.createDataFrame([(2021, 15), (2022, 20), (2023, 10), (2024, 5)], "tab long, value long") \
        .withColumn("is_row_total", F.lit(True)).withColumn("is_col_total", F.lit(True))
    ov = {r["tab"]: r["YEARLY_GROWTH"] for r in growth.overall_growth(totals, "tab").collect()}
    assert ov == pytest.approx({2021: 0.0, 2022: 1 / 3, 2023: -0.5, 2024: -0.5})


def test_m2_growth_needs_numeric_tabs(spark):
    src = spark.createDataFrame([("x", "a", 1), ("y", "a", 2)], "tab string, k string, value long")
    assert growth.series_growth(src, "tab", ["k"]).count() == 0


def test_m3_decode(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (7.0,), (None,)], "C double")
    cb = Codebook({"C": {"codes": {1: "A", 2: "B", 3: "B"}}})
    assert [r["C"] for r in decode(df, cb).collect()] == ["A", "B", "B", "7", None]
    lk = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "code long, label string")
    cb2 = Codebook({}).with_lookup("C", lk, "code", "label")
    assert sorted(decode(df, cb2).collect(), key=lambda r: str(r["C"])) == \
        sorted(decode(df, cb).collect(), key=lambda r: str(r["C"]))


def test_m4_chapter_order(spark):
    df = spark.createDataFrame([("4-1-10",), ("4-1-2",), ("",), ("x",), ("4-1-1",)], "chapter string")
    got = [r["chapter"] for r in df.orderBy(*chapter_sort_columns("chapter")).collect()]
    assert got == ["4-1-1", "4-1-2", "4-1-10", "", "x"]


def test_m5_code_rank_with_duplicate_labels(spark):
    from statcube.operators.ordering import axis_order

    cb = Codebook({"L": {"codes": {11: "a", 12: "b", 13: "b", 99: "z"}}})
    ranks = {r["label"]: r["rank"] for r in cb.label_ranks(spark, "L").collect()}
    assert ranks == {"a": 11, "b": 13, "z": 99}
    cells = spark.createDataFrame([(1, lab, False) for lab in ["zz", "z", "b", "a"]] + [(1, None, True)],
                                  "t long, L string, tot boolean")
    got = [r["L"] for r in axis_order(cells, "t", ["L"], "tot", cb, "rk").orderBy("rk").collect()]
    assert got == [None, "a", "b", "z", "zz"]


def test_f1_weighted_averages(spark):
    df = spark.createDataFrame(
        [(2021, "A", "A", 10, 100, 10), (2021, "B", "B", 20, 400, 20),
         (2022, "A", "A", 30, 600, 30), (2022, "B", "B", 40, 1600, 40)],
        "DATA_YR long, CITY string, CITY2 string, CNT long, SUM_AGE long, CNT_AGE long")
    cb = Codebook({"CITY2": {"name": "城市", "avg": {"num": "SUM_AGE", "den": "CNT_AGE"}}})
    got = {(r["DATA_YR"], r["CITY"]): (r["avg_name"], r["avg_value"])
           for r in weighted_averages(df, "DATA_YR", ["CITY"], ["CITY2"], cb).collect()}
    assert got[(2021, "A")] == ("平均城市", pytest.approx(10.0))
    assert got[(2021, "B")][1] == pytest.approx(20.0)
    assert got[(2021, None)][1] == pytest.approx(500 / 30)
    assert got[(2022, "A")][1] == pytest.approx(20.0)
    assert got[(2022, None)][1] == pytest.approx(2200 / 70)


def test_averages_need_column_dim_with_avg(spark):
    df = spark.createDataFrame([(2021, "A", 1, 1, 1)], "DATA_YR long, CITY string, CNT long, SUM_AGE long, CNT_AGE long")
    cb = Codebook({"CITY": {"avg": {"num": "SUM_AGE", "den": "CNT_AGE"}}})
    assert weighted_averages(df, "DATA_YR", ["CITY"], [], cb).count() == 0


def test_empty_cube_gives_empty_results(spark):
    from statcube.plans.crosstab import Crosstab
    from statcube.plans.spec import CrosstabSpec

    empty = spark.createDataFrame([], M1_SCHEMA)
    xt = Crosstab(empty, CrosstabSpec.of("Y", ["A"], ["B"]), Codebook())
    assert xt.cells().count() == 0
    assert xt.reference_totals().count() == 0
    assert xt.growth("rows").count() == 0
    assert xt.growth("all").count() == 0
    assert xt.mix().count() == 0


def test_tab_value_restricts_one_tab(spark):
    df = spark.createDataFrame(M1 + [(2, "a", None, 5, "正常"), (2, None, None, 5, "正常")], M1_SCHEMA)
    one = smart_filter(df, "Y", ["A"], [], {}, tab_value=2).collect()
    assert [(r["Y"], r["A"], r["CNT"]) for r in one] == [(2, "a", 5)]


def test_bin_coarsening_merges_codes(spark):
    """Two codes with one label decode to the same label and are summed as one
    crosstab row (many-to-one code lists)."""
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (1, None, 60)], "Y long, G long, CNT long")
    cb = Codebook({"G": {"codes": {1: "low", 2: "high", 3: "high"}}})
    cells = xt.crosstab_cells(smart_filter(decode(df, cb), "Y", ["G"], [], {}), "Y", ["G"], [], "CNT")
    got = {r["G"]: r["value"] for r in cells.where(~F.col("is_col_total")).collect()}
    assert got == {"low": 10, "high": 50, None: 60}


def test_tab_order_rules(spark):
    from statcube.operators.ordering import tab_order
    from statcube.plans import orders_cube as oc

    sf = "/root/testdata/sf0.001"
    cube = oc.decoded_cube(spark, sf)
    coded = [r["COUNTY"] for r in tab_order(cube, "COUNTY", oc.codebook(spark, sf)).orderBy("tab_rank").collect()]
    assert coded[:3] == ["NATION_0", "NATION_1", "NATION_2"] and coded.index("NATION_10") > coded.index("NATION_9")
    years = [r["DATA_YR"] for r in tab_order(cube, "DATA_YR").orderBy("tab_rank").collect()]
    assert years == sorted(years, reverse=True)
    numeric_text = spark.createDataFrame([("10",), ("9",), ("100",)], "T string")
    assert [r["T"] for r in tab_order(numeric_text, "T").orderBy("tab_rank").collect()] == ["9", "10", "100"]
    mixed = spark.createDataFrame([("10",), ("9",), ("x",)], "T string")
    assert [r["T"] for r in tab_order(mixed, "T").orderBy("tab_rank").collect()] == ["10", "9", "x"]


def test_weeks_of_two_years_stay_apart(spark, tmp_path):
    from statcube.plans import events_cube as ec

    rows = [("2024-01-03 10:00:00", "a", 1.0), ("2025-01-03 10:00:00", "a", 1.0), ("2024-12-31 10:00:00", "a", 1.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value").write.parquet(
        f"{tmp_path}/events.parquet")
    got = {r.WEEK: r.CNT for r in ec.cube(spark, str(tmp_path)).where("EVENT is null and BAND is null").collect()}
    assert got == {202401: 1, 202501: 2}


def test_fractional_quantities_are_summed_whole(spark, tmp_path):
    from statcube.plans import lineitem_cube as lc

    rows = [("2024-01-03", "A", "F", 1.9), ("2024-01-04", "A", "F", 1.9)]
    spark.createDataFrame(rows, "d string, l_returnflag string, l_linestatus string, l_quantity double").selectExpr(
        "cast(d as date) l_shipdate", "l_returnflag", "l_linestatus", "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert lc.cube(spark, str(tmp_path)).where("GID = 3").first().SUM_QTY == 3.8


def test_wide_sheet_keeps_columns_of_one_name(spark):
    from statcube.operators.layout import to_wide

    mix = spark.createDataFrame([("r", "全國", 0, 5.0), ("r", "全國", 1, 2.0), ("r", "b", 2, 3.0)], "k string, column string, col_order long, value double")
    wide = to_wide(mix, ["k"])
    assert wide.columns == ["k", "全國", "全國 #1", "b"] and tuple(wide.first()) == ("r", 5.0, 2.0, 3.0)
