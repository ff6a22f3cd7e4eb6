"""Scalar helpers, spec parsing and validation."""

import pytest
from pyspark.sql import functions as F

from statcube.functions import dataset_type, format_class, sheet_name, strip_masked_note
from statcube.plans.spec import CrosstabSpec
from statcube.sources.specs import parse_filters


def test_parse_filters(spark):
    df = spark.createDataFrame([("{'OWNED_TYPE': ('a', 'b')}",), ("{'Y': (2024,)}",), ("junk",), (None,)], "f string")
    got = [r["m"] for r in df.select(parse_filters("f").alias("m")).collect()]
    assert got == [{"OWNED_TYPE": ["a", "b"]}, {"Y": ["2024"]}, {}, {}]


def test_sheet_name_and_note(spark):
    df = spark.createDataFrame([("4-1-1", 0), ("", 3), ("a/b:c*d?e[f]" + "x" * 40, 1)], "ch string, pos int")
    got = [r[0] for r in df.select(sheet_name("ch", "pos")).collect()]
    assert got == ["4-1-1", "Report_3", ("abcdef" + "x" * 40)[:31]]
    note = "keep\n此分組包含 5 組被遮蔽資料（樣本數小於 3 筆）。（而未經篩選及遮蔽的本分組總計應為: 1,234 宅）\n"
    assert spark.createDataFrame([(note,)], "d string").select(strip_masked_note("d")).first()[0] == "keep"


def test_format_class_and_dataset_type(spark):
    df = spark.createDataFrame([("a(%)",), ("平均屋齡",), ("Average price",), ("全國",)], "n string")
    assert [r[0] for r in df.select(format_class("n")).collect()] == ["percent", "decimal2", "decimal2", "integer"]
    names = spark.createDataFrame([("/d/所有權_coded_202602040949.parquet",), ("/d/稅電_coded_1.parquet",),
                                   ("/d/orders.parquet",)], "p string")
    assert [r[0] for r in names.select(dataset_type("p")).collect()] == ["ownership", "power", None]


def test_spec_validation():
    with pytest.raises(ValueError):
        CrosstabSpec.of("DATA_YR", ["A"], ["A"])
    with pytest.raises(ValueError):
        CrosstabSpec.of("DATA_YR", ["A", "B", "C"], [])
    with pytest.raises(ValueError):
        CrosstabSpec.of("DATA_YR", [], ["A"])
    assert CrosstabSpec.of("DATA_YR", "A", "B").rows == ("A",)


def test_in_filter_coercion(spark):
    from statcube.operators.filters import in_filter

    df = spark.createDataFrame([(2021, "a", 1), (2022, "b", 2)], "DATA_YR long, S string, CNT long")
    assert in_filter(df, {"DATA_YR": ["2021"], "CNT": [2], "NOPE": [1]}).count() == 1
    assert in_filter(df, {"S": [1]}).count() == 0
    big = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "K long")
    assert [r.K for r in in_filter(big, {"K": ["9007199254740993"]}).collect()] == [9007199254740993]
    assert in_filter(big, {"K": [1.5, "x"]}).count() == 0
    assert in_filter(df, {"DATA_YR": ["2021", "x"]}).count() == 0 and in_filter(df, {"DATA_YR": [2021, "x"]}).count() == 1


def test_auto_title_and_reorder(spark):
    from pyspark.sql import functions as F

    from statcube.operators.layout import reorder_columns
    from statcube.plans.report import auto_title

    df = spark.createDataFrame(
        [("2025", {"OWNED_TYPE": ["單獨持有", "多人持有"]}, ["COUNTY"], ["AGE"]),
         ("2024", {"OWNED_TYPE": ["多人持有"]}, ["COUNTY"], []),
         ("2023", None, [], ["AGE"])],
        "tab string, f map<string,array<string>>, r array<string>, c array<string>")
    got = [x[0] for x in df.select(auto_title(F.col("tab"), F.col("f"), F.col("r"), F.col("c"),
                                              {"COUNTY": "縣市", "AGE": "屋齡區間"})).collect()]
    assert got == ["2025 年所有權單獨持有住宅縣市分佈 - 按縣市與屋齡區間區分",
                   "2024 年所有權多人持有住宅縣市分佈 - 按縣市與總計區分",
                   "2023 年住宅總計分佈 - 按總計與屋齡區間區分"]
    assert reorder_columns(df, ["c", "nope", "tab"]).columns == ["c", "tab", "f", "r"]


def test_small_helpers(spark):
    from statcube.functions import data_suffix, fmt_count, fmt_decimal, fmt_percent

    df = spark.createDataFrame([("C:\\Users\\x\\data\\260204\\a.parquet", 1234567.456, 0.12345)], "p string, v double, r double")
    row = df.select(data_suffix("p"), fmt_count("v"), fmt_decimal("v"), fmt_percent("r")).first()
    assert tuple(row) == ("260204/a.parquet", "1,234,567", "1,234,567.46", "12.35%")


def test_index_columns_are_dropped_at_ingest(spark, tmp_path):
    from statcube.sources.ingest import read_delivery_csv

    (tmp_path / "a.csv").write_text(",CNT,_c0de\n0,1,x\n")
    df = read_delivery_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["CNT", "_c0de"]


def test_sorted_values(spark):
    from statcube.operators.drill import distinct_values

    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, "a")], "n long, s string")
    got = [(r["column"], r["value"]) for r in distinct_values(df, sort=True).collect()]
    assert got == [("n", "10"), ("n", "9"), ("s", "a"), ("s", "b")]
