"""Sources and sinks: catalogue, CSV ingest, streaming ingest, report batch."""

import os
import tempfile

import pytest

from statcube.sources.codebook import Codebook
from statcube.sources.catalog import list_datasets
from statcube.sources.ingest import convert_delivery, ingest_delivery, types_of
from statcube.sources.manifest import catalogue, read_manifest, write_dataset

SF = "/root/testdata/sf0.001"


def test_catalog(spark):
    cat = list_datasets(spark, SF)
    names = {r["name"] for r in cat.collect()}
    assert {"orders.parquet", "nation.parquet"} <= names


def _write_delivery(spark, folder):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    region = spark.read.parquet(f"{SF}/region.parquet")
    for name, df in (("nation_coded", nation), ("region_coded", region)):
        pdf = df.toPandas()
        pdf.to_csv(os.path.join(folder, f"{name}.csv"), index=True)  # with an unnamed index column


def test_convert_delivery(spark):
    folder = tempfile.mkdtemp(prefix="statcube-delivery-")
    _write_delivery(spark, folder)
    written = convert_delivery(spark, folder)
    assert len(written) == 2
    back = spark.read.parquet(os.path.join(folder, "nation_coded.parquet"))
    assert back.count() == 25 and "_c0" not in back.columns and "n_name" in back.columns


def test_catalogue_of_written_datasets(spark, tmp_path):
    from statcube.sources.catalog import require_dataset_types

    folder = str(tmp_path / "data")
    spark.range(100).repartition(3).write.parquet(f"{folder}/所有權_coded_1.parquet")
    spark.range(5).write.parquet(f"{folder}/sub/other.parquet")
    cat = list_datasets(spark, folder)
    rows = {r["name"]: r for r in cat.collect()}
    assert set(rows) == {"所有權_coded_1.parquet", "other.parquet"}
    assert rows["所有權_coded_1.parquet"]["dataset_type"] == "ownership" and rows["other.parquet"]["dataset_type"] is None
    assert rows["other.parquet"]["below_data"] == "sub/other.parquet"
    assert require_dataset_types(cat.where("name <> 'other.parquet'")).count() == 1
    with pytest.raises(Exception, match="other.parquet"):
        require_dataset_types(cat).collect()


def test_reads_are_fresh_and_keep_columns(spark, tmp_path):
    from statcube.sources.tables import read_table

    spark.createDataFrame([(1, 2, 3)], "_c0de long, _c01 long, CNT long").write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").columns == ["_c0de", "_c01", "CNT"]
    spark.createDataFrame([(1, 2, 3)], "_c0de long, _c01 long, CNT long").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 2


def test_intermediate_tables_can_be_dropped(spark):
    from statcube.session import cut_lineage, drop_intermediates

    drop_intermediates(spark)
    df = cut_lineage(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and drop_intermediates(spark) == 1 and not os.path.exists(path)


def test_a_failing_spec_leaves_the_others(spark):
    """A bad filter value, a sheet name taken twice, and one good sheet."""
    from statcube.plans.report import ReportBatch
    from statcube.sources.specs import specs_frame

    cube = spark.createDataFrame([(2020, "a", "2020-01-01", 1), (2020, "b", "2020-01-02", 2)], "Y long, A string, d string, CNT long").selectExpr(
        "Y", "A", "cast(d as date) D", "CNT")
    base = dict(data_source="c", pivot_row=["A"], pivot_col=[], pivot_tab="Y", pivot_sum="CNT", filters="{}", unit="u")
    specs = specs_frame(spark, [dict(base, chapter="1", name="good"), dict(base, chapter="2", name="bad", filters="{'D': ('no date',)}"),
                                dict(base, chapter="1", name="twin"), dict(base, chapter="[]", name="no chapter")])
    batch = ReportBatch(specs, {"c": lambda: (cube, Codebook())})
    assert {r.sheet for r in batch.cells().collect()} == {"1", "Report_3"}
    assert sorted(r.Name for r in batch.errors().collect()) == ["bad", "twin"]
    assert {r.headline for r in batch.notes().collect()} == {"good (單位: u)", "no chapter (單位: u)"}
    assert {r.column for r in batch.cells().collect()} == {"全國", "CNT", "CNT(%)"}


def test_report_batch_errors_and_toc(spark):
    import __spark_entry__ as E

    rb = E._report(spark, "/root/testdata/sf0.001")
    errs = rb.errors().collect()
    assert [e["Chapter"] for e in errs] == ["x"]
    toc = [r["sheet"] for r in rb.toc().orderBy("sheet_rank").collect()]
    assert toc == ["4-1-1", "4-1-2", "4-1-10", "Report_3", "x"]


def test_manifest_notes_what_was_written_last(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, None, 2.5, "b"), (None, None, -1.0, "a")], "k long, none string, x double, `a.b` string")
    write_dataset(df, root, "稅籍_coded_1")
    write_dataset(df.limit(0), root, "plain")
    write_dataset(df.union(df), root, "稅籍_coded_1")
    got = {(r["dataset"], r["column"]): r for r in read_manifest(spark, root).collect()}
    assert len(got) == 8 and got["稅籍_coded_1", "k"]["n_rows"] == 4 and got["稅籍_coded_1", "k"]["n_nulls"] == 2
    one = got["稅籍_coded_1", "x"]
    assert (one["min_text"], one["max_text"], one["kind"]) == ("-1.0000", "2.5000", "double")
    assert got["plain", "x"]["n_rows"] == 0 and got["plain", "x"]["min_text"] is None
    assert got["稅籍_coded_1", "none"]["n_nulls"] == 4 and got["稅籍_coded_1", "a.b"]["max_text"] == "b"
    rows = catalogue(spark, root).collect()
    assert {r["name"]: (r["dataset_type"], r["by_time"], r["by_name"]) for r in rows} == {"稅籍_coded_1": ("tax", 1, 2), "plain": (None, 2, 1)}
    assert [r["name"] for r in catalogue(spark, root, ["plain"]).collect()] == ["稅籍_coded_1"]
    assert read_manifest(spark, root).where("dataset = '稅籍_coded_1'").agg({"checksum": "sum"}).first()[0] == 2 * sum(
        int(__import__("hashlib").md5(t.encode()).hexdigest()[:8], 16) for t in ("1", "2.5000", "-1.0000", "a", "b"))


def test_types_inferred_in_the_pass_that_reads_the_csv(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text(",i,gap,f,d,t,flag,text,empty,big,mixed\n"
                                  "0, 7 ,1,1.5,2024-01-31,2024-01-31 10:00:00,True,x,,99999999999999999999,1\n"
                                  "1,-3,,2e3,2024-02-29,2024-02-01T00:00:00,false,7,,1,2024-01-01\n")
    (folder / "b.csv").write_text("n,s\n007,\"one, two\"\n8,\"say \"\"hi\"\"\"\n")
    types = ingest_delivery(spark, str(folder), root)
    assert types["a"] == {"i": "long", "gap": "double", "f": "double", "d": "date", "t": "timestamp", "flag": "boolean", "text": "string", "empty": "double",
                          "big": "double", "mixed": "string"}
    back = spark.read.parquet(f"{root}/a.parquet").orderBy("i").collect()
    assert (back[1]["i"], back[1]["gap"], back[0]["gap"], back[0]["f"], str(back[0]["d"]), back[0]["flag"]) == (7, 1.0, None, 2000.0, "2024-02-29", False)
    assert types["b"] == {"n": "long", "s": "string"} and sorted(r["n"] for r in spark.read.parquet(f"{root}/b.parquet").collect()) == [7, 8]
    assert {r["dataset"] for r in read_manifest(spark, root).collect()} == {"a", "b"}


def test_narrowest_type():
    seen = {f"{k}_0": k in ("double", "timestamp") for k in ("boolean", "long", "double", "date", "timestamp")} | {"nulls_0": 1, "rows_0": 3}
    assert types_of(["c"], seen) == {"c": "double"}


def test_digests_are_summed_as_longs(spark):
    """A sum of decimals works its input out more than once a row; two sums of
    longs have room for any number of rows."""
    from statcube.sources.manifest import checksum, profile_metrics

    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, k long")
    plan = df.agg(*profile_metrics(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 4 and "decimal" not in plan
    got = df.agg(*profile_metrics(df)).first().asDict()
    assert [int(checksum(got, i)) for i in (0, 1)] == [
        sum(int(__import__("hashlib").md5(t.encode()).hexdigest()[:8], 16) for t in texts) for texts in (["a"], ["1", "2"])]
    # a hundred billion of the largest digest
    many = 10 ** 11
    assert checksum({"c_hi_0": many * 65535, "c_lo_0": many * 65535}, 0) == many * (2 ** 32 - 1)
    assert checksum({"c_hi_0": None, "c_lo_0": None}, 0) == 0


def test_catalogue_writes_several_datasets_at_once(spark, monkeypatch):
    import threading

    import __spark_entry__ as E

    together = threading.Barrier(4, timeout=60)

    def write(df, root, name):
        together.wait()
        return write_dataset(df, root, name)

    monkeypatch.setattr(E, "write_dataset", write)
    assert E._catalogue(spark, SF).count() == 7
