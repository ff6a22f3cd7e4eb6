"""Blocked key grid, growth arrays, and report sheets from one aggregate."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from statcube.operators import crosstab as xt
from statcube.operators import growth
from statcube.operators.filters import rows_of_tab
from statcube.plans.crosstab import Crosstab
from statcube.plans.report import ReportBatch
from statcube.plans.shared import SharedSheets, SheetSpec
from statcube.plans.spec import CrosstabSpec
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook
from tests.test_plans import plan_text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block, salt_rows", [(1024, 16384), (1, 1), (3, 2)])
def test_grid_is_every_row_with_every_key(spark, block, salt_rows):
    left = [(1, "a"), (2, None), (2, None), (None, "c"), (9, "z")]
    right = [(f"k{i}",) for i in range(17)] + [(None,)]
    a, b = spark.createDataFrame(left, "g long, l string"), spark.createDataFrame(right, "r string")
    got = sorted((tuple(x) for x in xt.key_grid(a, b, block=block, salt_rows=salt_rows).collect()), key=str)
    assert got == sorted([(*x, *y) for x in left for y in right], key=str)
    keyed = [(g, f"k{i}") for g, n in ((1, 5), (2, 1), (7, 3)) for i in range(n)]
    got = xt.key_grid(a, spark.createDataFrame(keyed, "g long, r string"), on=["g"], block=block, salt_rows=salt_rows)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted([(*x, r) for x in left for g, r in keyed if g == x[0]], key=str)
    assert xt.key_grid(a, b.limit(0)).count() == 0 and xt.key_grid(a.limit(0), b).count() == 0


def test_more_columns_than_a_block_holds(spark):
    """5,000 column keys over 3 tabs; every row key meets all of them."""
    rows = spark.range(15_000).select((F.col("id") % 3 + 2000).alias("T"), F.concat(F.lit("r"), F.col("id") % 7).alias("A"),
                                      F.concat(F.lit("c"), F.col("id") % 5000).alias("B"), F.lit(1).cast("long").alias("CNT"))
    cells = xt.crosstab_cells(rows, "T", ["A"], ["B"], "CNT")
    inner = cells.where("not is_row_total and not is_col_total")
    assert inner.agg(F.count("*"), F.sum("value")).first() == (3 * 7 * 5000, 15_000)
    assert inner.groupBy("T", "A").agg(F.countDistinct("B").alias("n")).select(F.min("n")).first()[0] == 5000


@pytest.mark.parametrize("name", ["crosstab_cells", "crosstab_2x2", "heat_scale", "axis_order_cols", "mix_report", "report_cells", "growth_rows", "growth_cols",
                                  "preset_table_1", "lineitem_crosstab"])
def test_no_key_list_is_a_scalar(spark, name):
    """Scalar subqueries return counts only."""
    text = plan_text(E.queries()[name](spark, SF))
    assert "collect_set" not in text
    subqueries = text.split("===== Subqueries =====")[1] if "===== Subqueries =====" in text else ""
    assert "collect_list" not in subqueries and "CartesianProduct" not in text and "NestedLoop" not in text


def test_growth_is_as_with_carried_values(spark):
    rng = random.Random(4)
    tabs = [2001, 2003, 2004, 2010]
    rows = [(t, k, rng.choice([0, 5, 10])) for k in "abcdef" for t in tabs if rng.random() < 0.6]
    got = {(r.T, r.k): r.growth_pct for r in growth.series_growth(spark.createDataFrame(rows, "T long, k string, value long"), "T", ["k"]).collect()}
    seen = sorted({t for t, _, _ in rows})
    for k in {k for _, k, _ in rows}:
        value = {t: v for t, kk, v in rows if kk == k}
        last = None
        for i, t in enumerate(seen):
            now = value.get(t, last)
            if i:
                want = None if last is None or now is None or last == now == 0 else float("inf") if last == 0 else (now / last - 1) * 100
                assert got.pop((t, k)) == (pytest.approx(want) if want is not None else None)
            last = now
    assert not got


def _cube(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(900):
        rows.append((rng.randint(2019, 2022), rng.choice("pqr"), rng.choice(["10", "9", "100"]), rng.choice(["x", "y'z", "w, v"]), rng.randint(1, 4), rng.randint(1, 50), 2))
    return cut_lineage(spark.createDataFrame(rows, "Y long, A string, N string, B string, S long, CNT long, W long")
                       .groupBy("Y", "A", "N", "B", "S").agg(F.sum("CNT").alias("CNT"), F.sum("W").alias("SUM_W")))


BOOK = Codebook({"A": {"name": "The A", "codes": {3: "p", 1: "q", 2: "r"}}, "B": {"name": "B", "avg": {"num": "SUM_W", "den": "CNT"}}})
SPECS = [CrosstabSpec.of(*x) for x in itertools.chain(
    [("Y", ["A"], ["B"]), ("Y", ["A", "B"], ["S", "N"], "SUM_W"), ("N", ["S"], []), ("A", ["Y"], ["B", "N"], "CNT", {"Y": [2019, 2020]}), ("S", ["B"], ["A"]),
     ("B", ["N"], ["S"], "CNT", {"S": ["1", 2]}), ("Y", ["B"], ["A"], "CNT", {"A": ["none"]})])]


def test_shared_sheets_equal_single_crosstabs(spark):
    cube = _cube(spark)
    sheets = [SheetSpec(i, s, w) for i, (s, w) in enumerate(zip(SPECS, ["2020", "1999", None, "q", "4", None, None]))]
    shared = SharedSheets(cube, BOOK, sheets)
    focus = {r["sheet_rank"]: r["tab"] for r in shared.focus.collect()}
    assert focus == {0: "2020", 1: "2019", 2: "9", 3: "q", 4: "4", 5: "w, v"}
    got = {i: [] for i in range(len(SPECS))}
    for r in shared.cells().collect():
        got[r["sheet_rank"]].append((r.tab, r.row_1, r.row_2, r.is_row_total, r.column, r.kind, r.value, r.col_order, r.format))
    for s in sheets[:-1]:
        x = s.spec
        mix = rows_of_tab(Crosstab(cube, x, BOOK).mix(), x.tab, focus[s.id])
        want = [(str(r[x.tab]), r[x.rows[0]], r[x.rows[1]] if len(x.rows) > 1 else None, r.is_row_total, r.column, r.kind, r.value, r.col_order, r.format) for r in mix.collect()]
        want = [(t, str(a), b, *rest) for t, a, b, *rest in want]
        assert sorted(got[s.id], key=str) == sorted(want, key=str), x
    assert got[6] == []


def _batch(spark, n):
    one = {r["chapter"]: r for r in E.read_specs(spark, E.SPECS_PATH).collect()}["4-1-1"].asDict()
    specs = spark.createDataFrame([{**one, "chapter": f"1-{i}"} for i in range(n)], E.read_specs(spark, E.SPECS_PATH).schema)
    cube = cut_lineage(E.oc.decoded_cube(spark, SF))
    return ReportBatch(specs, {"orders_cube": lambda: (cube, E.oc.codebook(spark, SF))}, materialize=False)


def test_jobs_do_not_grow_with_the_sheets(spark):
    def jobs(n):
        batch = _batch(spark, n)
        group = f"sheets-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert batch.cells().select("sheet").distinct().count() == n and batch.notes().count() == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(2) + 2


def test_a_run_time_failure_stays_with_its_sheet(spark):
    batch = _batch(spark, 5)
    bad = F.col("chapter") == "1-3"
    batch.specs = batch.specs.withColumn("pivot_sum", F.when(bad, F.lit("SEG")).otherwise(F.col("pivot_sum")))
    errors = batch.errors().collect()
    assert [e["Chapter"] for e in errors] == ["1-3"] and "CAST_INVALID_INPUT" in errors[0]["Error"] and len(errors[0]["Error"]) > 150
    assert batch.cells().select("sheet").distinct().count() == 4 == batch.notes().count()


def test_a_sheet_of_fifty_thousand_columns(spark, tmp_path):
    from statcube.operators.layout import column_blocks, sheet_blocks, to_wide, write_wide

    n = 50_000
    mix = spark.range(2 * n).select((F.col("id") % 2).alias("r"), F.floor(F.col("id") / 2).alias("col_order")).select(
        "r", "col_order", F.concat(F.lit("c"), F.col("col_order") % 49_999).alias("column"), (F.col("col_order") * 10 + F.col("r")).cast("double").alias("value"))
    mix = mix.where("not (r = 1 and col_order = 7)")
    write_wide(mix, ["r"], str(tmp_path / "sheet"))
    back = spark.read.parquet(str(tmp_path / "sheet"))
    assert back.count() == 100 and len(list((tmp_path / "sheet").glob("block=*"))) == 50
    got = {(r["r"], r["block"]): (r["names"], r["values"]) for r in back.where("block in (0, 49)").collect()}
    assert got[0, 0][0][:3] == ["c0", "c1", "c2"] and got[0, 0][1] == [10.0 * i for i in range(1000)]
    assert got[1, 0][1][6:9] == [61.0, None, 81.0] and got[1, 49][0][-1] == "c0" and got[1, 49][1][-1] == 499_991.0
    with pytest.raises(ValueError, match="blocks"):
        to_wide(mix, ["r"])
    twins = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "A", 2.0), (1, 2, "r", 3.0)], "r int, col_order long, column string, value double")
    assert to_wide(twins, ["r"]).columns == ["r", "a", "A #1", "r #2"] and to_wide(twins.limit(0), ["r"]).columns == ["r"]
    assert sheet_blocks(twins, ["r"], 2).count() == 2 == column_blocks(twins, 2).count()
