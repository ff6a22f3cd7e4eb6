"""

``entry(spark)`` runs the flagship crosstab on sf0.001; ``queries()`` maps
each implemented operator to a callable (spark, sf_dir) -> DataFrame;
``oracle_sql()`` gives the independent DuckDB SQL for each of them.

Every query starts from the provided tables: the order-statistics cube is
built from orders ⋈ customer with GROUPING SETS, decoded through nation /
region, and the operator under test runs on top of it.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle as O  # noqa: E402
from statcube.operators import cube as cube_ops  # noqa: E402
from statcube.operators import decode as dec  # noqa: E402
from statcube.operators import drill, filters  # noqa: E402
from statcube.operators.crosstab import mean_crosstab  # noqa: E402
from statcube.operators.layout import to_wide  # noqa: E402
from statcube.operators.probe_index import ProbeIndex  # noqa: E402
from statcube.plans import events_cube as ec  # noqa: E402
from statcube.plans import lineitem_cube as lc  # noqa: E402
from statcube.plans import orders_cube as oc  # noqa: E402
from statcube.plans.crosstab import Crosstab  # noqa: E402
from statcube.plans.spec import CrosstabSpec  # noqa: E402
from statcube.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from statcube.plans.presets import load_presets, preset_batch, preset_crosstab  # noqa: E402
from statcube.plans.report import ReportBatch  # noqa: E402
from statcube.functions import DATASET_PREFIXES, basename, data_suffix, dataset_prefix, epoch_text, file_stem, fmt_count, fmt_decimal, fmt_percent, numeric_text  # noqa: E402
from statcube.operators.layout import reorder_columns, sheet_blocks  # noqa: E402
from statcube.sources.catalog import require_dataset_types  # noqa: E402
from statcube.sources.codebook import REGION_COUNTIES, Codebook  # noqa: E402
from statcube.sources.ingest import convert_delivery, ingest_delivery  # noqa: E402
from statcube.sources.manifest import catalogue, read_manifest, write_dataset  # noqa: E402
from statcube.sources.specs import read_specs  # noqa: E402
from statcube.sources.tables import read_parquet, read_table  # noqa: E402

CONFIG_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "statcube", "config")
SPECS_PATH = os.path.join(CONFIG_DIR, "report_specs.jsonl")
FAILING_SPECS_PATH = os.path.join(CONFIG_DIR, "report_specs_failing.jsonl")
PRESETS_PATH = os.path.join(CONFIG_DIR, "presets.yaml")

SMOKE_DIR = "/root/testdata/sf0.001"

try:  # operators of training-data pipelines, where that subpackage is present
    from llm import queries as llm_queries
except ImportError as missing:  # the folder is gone, or an empty one is left
    if (missing.name or "").split(".")[0] not in ("llm", "corpus_pipeline"):
        raise
    llm_queries = None

# Crosstab specs used by the queries below.
MAIN = dict(tab="DATA_YR", rows=["COUNTY"], cols=["SEG"], metric="CNT", filters={})
TWO_BY_TWO = dict(tab="DATA_YR", rows=["REGION", "COUNTY"], cols=["SEG", "PRI"], metric="CNT", filters={})
NO_COLS = dict(tab="DATA_YR", rows=["COUNTY"], cols=[], metric="SUM_PRICE", filters={"PRI": ["1-URGENT", "2-HIGH"]})
GROWTH = dict(tab="DATA_YR", rows=["COUNTY"], cols=["PRI"], metric="CNT", filters={"SEG": ["BUILDING"]})
AVG = dict(tab="DATA_YR", rows=["COUNTY"], cols=["SEG", "PRI"], metric="CNT", filters={})
PROBED = dict(tab="DATA_YR", rows=["COUNTY"], cols=[], filters={"SEG": ["BUILDING", "FURNITURE"]})
REGION_FULL = dict(tab="DATA_YR", rows=["REGION"], cols=[], filters={})
REF = dict(tab="DATA_YR", rows=["COUNTY"], cols=[], filters={"SEG": ["BUILDING"]})
REF_DERIVED = dict(tab="DATA_YR", rows=["SEG"], cols=[], filters={"COUNTY": ["NATION_1", "NATION_2"]})
AVG_NAMES = ["Average price", "平均Priority"]
EVENTS_XT = dict(tab="WEEK", rows=["EVENT"], cols=["BAND"], metric="CNT", filters={})
LINEITEM_XT = dict(tab="DATA_YR", rows=["FLAG"], cols=["LSTATUS"], metric="SUM_QTY", filters={})
# Market segments of the order data (the wide sheet has one value and one
# percent column per segment).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# The given tables as delivered datasets: type prefix, "_coded", table.
DELIVERED = {t: f"{list(DATASET_PREFIXES)[i % len(DATASET_PREFIXES)]}_coded_{t}" for i, t in enumerate(
    ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"])}
DISABLED = [DELIVERED["supplier"], "no such dataset"]
# Expected sheets of the saved specs, in chapter order (spec, sheet, rank,
# focus tab or None for "latest", average names, chapter, title, description).
REPORT_SHEETS = [
    (dict(tab="DATA_YR", rows=["COUNTY"], cols=["SEG"], metric="CNT", filters={"DATA_YR": [1996, 1997]}),
     "4-1-1", 1, None, ["Average price"], "4-1-1", "Orders by nation, two years (orders)", ""),
    (dict(tab="DATA_YR", rows=["COUNTY"], cols=["PRI"], metric="CNT", filters={"SEG": ["BUILDING"]}),
     "4-1-2", 2, None, ["平均Priority"], "4-1-2", "Orders by nation and priority ",
     "Building segment only.\n此分組包含 5 組被遮蔽資料（樣本數小於 3 筆）。（而未經篩選及遮蔽的本分組總計應為: 1,234 宅）"),
    (dict(tab="DATA_YR", rows=["COUNTY"], cols=["SEG"], metric="CNT", filters={"PRI": ["1-URGENT", "2-HIGH"]}),
     "4-1-10", 3, 1996, ["Average price"], "4-1-10", "Orders by nation and segment (orders)", ""),
    (dict(tab="DATA_YR", rows=["SEG"], cols=["PRI"], metric="SUM_PRICE", filters={}),
     "Report_3", 4, 1997, ["平均Priority"], "", "Order value by segment and priority (cents)", "Value in cents."),
]
DETAIL_NAMES = {"DATA_YR": "Order year", "COUNTY": "Nation", "SEG": "Market segment", "PRI": "Priority",
                "REGION": "Region"}
IN_FILTERS = {"DATA_YR": ["1996", "1997"], "SEG": ["BUILDING"], "CNT": [1], "NOPE": ["x"]}


def _xt(spark: SparkSession, sf_dir: str, spec: dict, probe: str = "prefix", materialize: bool = True) -> Crosstab:
    """Crosstab over the decoded orders cube. The cube is materialised when the
    query reads it more than once (probe / key pass, then the final plan);
    single-pass outputs (reference totals) read it straight from the tables."""
    s = CrosstabSpec.of(spec["tab"], spec["rows"], spec["cols"], spec.get("metric", "CNT"), spec["filters"], probe)
    return Crosstab(oc.decoded_cube(spark, sf_dir, materialize=materialize), s, oc.codebook(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> ReportBatch:
    sources = {"orders_cube": lambda: (oc.decoded_cube(spark, sf_dir), oc.codebook(spark, sf_dir))}
    return ReportBatch(read_specs(spark, SPECS_PATH), sources)


def _preset(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    task = load_presets(PRESETS_PATH)[i]
    return preset_crosstab(oc.decoded_cube(spark, sf_dir, materialize=True), oc.codebook(spark, sf_dir), task)


def _sql_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping-set fingerprint as SQL over a registered view (one view
    name per call, so concurrent callers never read each other's view)."""
    view = f"decoded_cube_{uuid.uuid4().hex}"
    oc.decoded_cube(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql("SELECT GID, " + ", ".join(
        f"CASE WHEN MAX({c}) IS NOT NULL THEN '{c}' ELSE NULL END AS has_{c.lower()}" for c in O.DIMS)
        + f" FROM {view} GROUP BY GID")


def _growth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statcube.operators.growth import growth_summary

    return growth_summary(_xt(spark, sf_dir, GROWTH).growth("all"), "DATA_YR")


def _crosstab_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals by grouping id: a missing nation or priority is a key of its own."""
    spec = CrosstabSpec.of("DATA_YR", ["COUNTY"], ["PRI"], "CNT", {"SEG": ["BUILDING", "(missing)"]})
    return Crosstab(cut_lineage(oc.cube_with_gaps(spark, sf_dir)), spec, layout=oc.layout()).cells(percentages=False)


def _mix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet in blocks of five columns: names, and the ends of the values."""
    blocks = sheet_blocks(_xt(spark, sf_dir, MAIN).mix(), ["DATA_YR", "COUNTY", "is_row_total"], block=5)
    return blocks.select("DATA_YR", "COUNTY", "is_row_total", "block", F.array_join("names", "|").alias("names"), F.size("values").cast("long").alias("n"),
                         F.array_min("values").alias("least"), F.array_max("values").alias("most"), F.get("values", F.lit(0)).alias("first"))


def _smart_filter_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes answered from the stored index instead of the cube."""
    cube = oc.decoded_cube(spark, sf_dir, materialize=True)
    spec = CrosstabSpec.of("DATA_YR", ["COUNTY"], [], "CNT", PROBED["filters"])
    return Crosstab(cube, spec, oc.codebook(spark, sf_dir), index=ProbeIndex.of(cube)).filtered


def _report_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's notes from a cube that has its index beside it."""
    cube = oc.decoded_cube(spark, sf_dir, materialize=True)
    return ReportBatch(read_specs(spark, SPECS_PATH), {"orders_cube": lambda: (cube, oc.codebook(spark, sf_dir), ProbeIndex.of(cube))}).notes()


def _report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that fail: at planning (axes that overlap, an unknown source) and
    at run time (a sum of text); the good one among them has its sheet."""
    sources = {"orders_cube": lambda: (oc.decoded_cube(spark, sf_dir), oc.codebook(spark, sf_dir))}
    batch = ReportBatch(read_specs(spark, FAILING_SPECS_PATH), sources)
    sheets = batch.notes().select(F.col("chapter").alias("Chapter"), F.col("title").alias("Name"), F.lit("").alias("Error"), F.col("ref_total").alias("total"))
    # a run-time error names its kind and the value first
    short = F.regexp_extract("Error", r"^(.*?)( because|$)", 1)
    return batch.errors().select("Chapter", "Name", short.alias("Error"), F.lit(None).cast("long").alias("total")).unionByName(sheets)


def _growth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over two tabs kept as text: years grow, priorities do not."""
    cube = cut_lineage(oc.decoded_cube(spark, sf_dir).withColumn("YEAR", F.col("DATA_YR").cast("string")))
    parts = []
    for tab in ("YEAR", "PRI"):
        spec = CrosstabSpec.of(tab, ["COUNTY"], ["SEG"], "CNT", {})
        parts.append(Crosstab(cube, spec).growth("all").select(F.lit(tab).alias("tab_dim"), F.col(tab).alias("tab"), "TOTAL", "YEARLY_GROWTH", "YEARLY_GROWTH_PCT"))
    return parts[0].unionByName(parts[1])


# County names in the order of the static region list; nations 0-19 stand for them.
COUNTIES = [(c, r) for r, names in REGION_COUNTIES.items() for c in names][:20]
NATION_BINS = {k: "0-9" if k < 10 else "10-19" if k < 20 else "20-24" for k in range(25)}


def _region_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region of the static list: some nations carry names that it
    lists, the others are unclassified."""
    codes = {"codes": {i: c for i, (c, _) in enumerate(COUNTIES)}}
    rows = dec.decode(oc.microdata(spark, sf_dir).select("COUNTY", "cents"), Codebook({"COUNTY": codes}))
    return dec.derive_region(rows).groupBy("REGION").agg(F.count("*").alias("n_orders"), F.sum("cents").alias("cents"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many codes to one label: nations in three bins, counted over the cube."""
    cube = dec.decode(oc.coded_cube(spark, sf_dir, suppress=False), Codebook({"COUNTY": {"codes": NATION_BINS}}))
    spec = CrosstabSpec.of("DATA_YR", ["COUNTY"], [], "CNT", {})
    return Crosstab(cut_lineage(cube), spec).cells(percentages=False)


def _headline(title: str) -> str:
    """The first line of a sheet, from its title in the table of contents."""
    name, _, unit = title.rpartition(" ")
    return f"{name} (單位: {unit[1:-1]})" if unit else name


def _presets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"orders_cube": lambda: (oc.decoded_cube(spark, sf_dir, materialize=True), oc.codebook(spark, sf_dir))}
    return preset_batch(load_presets(PRESETS_PATH), sources)


def _delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table delivered as CSV, converted to Parquet and read back."""
    part = read_table(spark, sf_dir, "part")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/delivery-{uuid.uuid4().hex}"
    part.write.option("header", True).csv(f"{folder}/in/part.csv")
    done = convert_delivery(spark, f"{folder}/in/part.csv", f"{folder}/out", schemas=part.schema)
    return read_parquet(spark, done[0] if len(done) == 1 else f"{folder}/out/*.parquet")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables written as datasets, several at once; the catalogue from
    their manifest."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/datasets-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda table: write_dataset(read_table(spark, sf_dir, table), root, DELIVERED[table]), DELIVERED))
    return require_dataset_types(catalogue(spark, root, DISABLED)).select("name", "dataset_type", "n_rows", "n_columns", "n_nulls", F.col("checksum").cast("string").alias("checksum"),
                                                   "by_name", "by_name_desc")


def _delivery_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables delivered as CSV without schemas (part sizes with gaps); the
    types that were inferred and the profile of each column."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/delivery-{uuid.uuid4().hex}"
    gaps = read_table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    for name, df in (("part", gaps), ("supplier", read_table(spark, sf_dir, "supplier")), ("orders", read_table(spark, sf_dir, "orders"))):
        df.write.option("header", True).csv(f"{base}/in/{name}.csv")
    ingest_delivery(spark, f"{base}/in", f"{base}/out")
    return read_manifest(spark, f"{base}/out").select("dataset", "column", "kind", "n_rows", "n_nulls", "min_text", "max_text",
                                                      F.col("checksum").cast("string").alias("checksum"))


def _path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of deliveries taken apart, one path a customer."""
    c = read_table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/srv/data/260204/"), F.col("c_mktsegment"), F.lit("_coded_"), F.col("c_custkey").cast("string"), F.lit(".v1.parquet"))
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("."))).when(
        F.col("c_custkey") % 3 == 1, F.lit("..")).otherwise(F.col("c_name"))
    c = c.select("c_custkey", path.alias("path"), label.alias("label"))
    return c.select("c_custkey", basename("path").alias("base"), file_stem("path").alias("stem"), data_suffix("path").alias("below_data"),
                    dataset_prefix("path").alias("prefix"), numeric_text("label").alias("is_number"),
                    epoch_text(F.timestamp_seconds(F.col("c_custkey") * 86_399)).alias("modified"))


def _number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report numbers of each market segment as text."""
    c = read_table(spark, sf_dir, "customer")
    g = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    return g.select("c_mktsegment", fmt_count(F.col("cents")).alias("whole"), fmt_decimal(F.col("cents") / 100).alias("decimal2"),
                    fmt_percent(F.col("n") / 100_000).alias("percent"))


def _events_xt(spark: SparkSession, sf_dir: str) -> Crosstab:
    cube = dec.decode(ec.cube(spark, sf_dir), ec.codebook())
    return Crosstab(cut_lineage(cube), CrosstabSpec.of(**EVENTS_XT), ec.codebook())


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: crosstab of orders by year × nation × segment with totals and
    row / column / total percentages."""
    return _xt(spark, SMOKE_DIR, MAIN).cells()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **(llm_queries.queries() if llm_queries else {}),
        # cube build, suppression, inspection
        "cube_build": lambda s, d: oc.coded_cube(s, d, suppress=False),
        "cube_suppress": lambda s, d: oc.coded_cube(s, d),
        "gid_fingerprint": lambda s, d: cube_ops.grouping_fingerprint(oc.decoded_cube(s, d), O.DIMS),
        "masked_ratio_by_gid": lambda s, d: cube_ops.masked_ratio(oc.decoded_cube(s, d)),
        # decode (P1, P3, P4)
        "decode_labels": lambda s, d: dec.decode(oc.coded_cube(s, d), oc.codebook(s, d)),
        "derive_region": lambda s, d: oc.decoded_cube(s, d),
        "unmapped_values": lambda s, d: dec.unmapped_counties(
            dec.decode(oc.coded_cube(s, d), oc.codebook(s, d)), mapping=REGION_COUNTIES),
        # filters (F1-F4)
        "filter_in_coerced": lambda s, d: filters.in_filter(oc.decoded_cube(s, d), IN_FILTERS),
        "smart_filter": lambda s, d: _xt(s, d, PROBED).filtered,
        "smart_filter_full": lambda s, d: _xt(s, d, REGION_FULL, probe="full").filtered,
        "smart_filter_lazy": lambda s, d: Crosstab(oc.decoded_cube(s, d, materialize=True), CrosstabSpec.of(
            "DATA_YR", ["COUNTY"], [], "CNT", PROBED["filters"]), oc.codebook(s, d), mode="lazy").filtered,
        # crosstab (A1-A3, J4, W1-W3, W9)
        "crosstab_cells": lambda s, d: _xt(s, d, MAIN).cells(percentages=False),
        "crosstab_pct": lambda s, d: _xt(s, d, MAIN).cells(),
        "crosstab_2x2": lambda s, d: _xt(s, d, TWO_BY_TWO).cells(),
        "crosstab_nocols": lambda s, d: _xt(s, d, NO_COLS).cells(),
        "heat_scale": lambda s, d: _xt(s, d, MAIN).heat(),
        # reference totals, weighted averages
        "reference_totals": lambda s, d: _xt(s, d, REF, materialize=False).reference_totals(),
        "reference_totals_derived": lambda s, d: _xt(s, d, REF_DERIVED, materialize=False).reference_totals(),
        "weighted_avg": lambda s, d: _xt(s, d, AVG).averages(),
        # growth (W4-W8)
        "growth_overall": lambda s, d: _xt(s, d, GROWTH).growth("all"),
        "growth_rows": lambda s, d: _xt(s, d, GROWTH).growth("rows"),
        "growth_cols": lambda s, d: _xt(s, d, GROWTH).growth("cols"),
        # ad-hoc mean crosstab of one grouping set
        "mean_crosstab": lambda s, d: mean_crosstab(cube_ops.grouping_set(oc.decoded_cube(s, d), 0),
                                                    ["COUNTY"], ["SEG"], ["CNT", "SUM_PRICE"]),
        # drill-through
        "distinct_values": lambda s, d: drill.distinct_values(oc.decoded_cube(s, d)),
        "drill_summary": lambda s, d: _xt(s, d, MAIN).drill_summary(),
        "masked_rows": lambda s, d: _xt(s, d, MAIN).masked(),
        "masked_detail": lambda s, d: _xt(s, d, MAIN).masked_detail(),
        # ordering (O1, O2) and report layout
        "tab_order": lambda s, d: _xt(s, d, MAIN).tab_order(),
        "axis_order": lambda s, d: _xt(s, d, MAIN).row_order(),
        "axis_order_cols": lambda s, d: _xt(s, d, GROWTH).col_order(),
        "mix_report": lambda s, d: _xt(s, d, MAIN).mix(),
        "mix_wide": lambda s, d: to_wide(_xt(s, d, MAIN).mix(), ["DATA_YR", "COUNTY", "is_row_total"]),
        # batch report (K2-K11, O3, C9, C10) and presets
        "report_cells": lambda s, d: _report(s, d).cells(),
        "report_notes": lambda s, d: _report(s, d).notes(),
        "preset_table_1": lambda s, d: _preset(s, d, 0),
        "preset_table_2": lambda s, d: _preset(s, d, 1),
        "preset_batch": _presets_all,
        "toc": lambda s, d: _report(s, d).toc(),
        "report_errors": lambda s, d: _report(s, d).errors(),
        "mix_nocols": lambda s, d: _xt(s, d, NO_COLS).mix(),
        "cube_with_gaps": oc.cube_with_gaps,
        "crosstab_with_gaps": _crosstab_with_gaps,
        "mix_blocks": _mix_blocks,
        "probe_index": lambda s, d: ProbeIndex.entries(oc.decoded_cube(s, d)),
        "smart_filter_indexed": _smart_filter_indexed,
        "report_indexed": _report_indexed,
        "report_failures": _report_failures,
        "growth_guard": _growth_guard,
        "reference_rows": lambda s, d: _xt(s, d, REF, materialize=False).reference_rows("1997"),
        "delivery_csv": _delivery,
        "region_static": _region_static,
        "coarse_bins": _bins,
        # catalogue (S4, S5, S9) and SQL over a registered view
        "catalog_enabled": _catalogue,
        "delivery_inferred": _delivery_inferred,
        "path_functions": _path_functions,
        "distinct_values_sorted": lambda s, d: drill.distinct_values(oc.decoded_cube(s, d), ["SEG", "DATA_YR"], sort=True),
        "number_formats": _number_formats,
        "columns_reordered": lambda s, d: reorder_columns(oc.decoded_cube(s, d), ["REGION", "NOPE", "CNT", "DATA_YR"]),
        "sql_gid_fingerprint": _sql_fingerprint,
        # a third cube from events: decode of a static code list, crosstab, averages
        "events_crosstab": lambda s, d: _events_xt(s, d).cells(),
        "events_weighted_avg": lambda s, d: _events_xt(s, d).averages(),
        # small inspection operators
        "distinct_gids": lambda s, d: cube_ops.distinct_gids(oc.decoded_cube(s, d)),
        "distinct_tabs": lambda s, d: drill.distinct_tabs(_xt(s, d, MAIN).filtered, "DATA_YR"),
        "grouping_set_rows": lambda s, d: cube_ops.grouping_set(oc.decoded_cube(s, d), 3),
        "published_rows": lambda s, d: cube_ops.split_status(oc.decoded_cube(s, d))[0],
        # growth summary (A14), one tab's rows (F5, F8, F12), preview (O5), display names
        "growth_summary": lambda s, d: _growth_summary(s, d),
        "tab_slice": lambda s, d: filters.rows_of_tab(_xt(s, d, MAIN).filtered, "DATA_YR", "1997"),
        "preview_rows": lambda s, d: drill.preview(_xt(s, d, MAIN).filtered, "DATA_YR", 1997, n=100),
        "display_names": lambda s, d: dec.rename_for_display(oc.decoded_cube(s, d), oc.codebook(s, d)),
        # a second cube from lineitem through the same builder and crosstab
        "lineitem_crosstab": lambda s, d: Crosstab(lc.cube(s, d, materialize=True), CrosstabSpec.of(
            **{k: v for k, v in LINEITEM_XT.items()}), lc.codebook()).cells(),
    }


def oracle_sql() -> dict[str, str]:
    cube_cols = "DATA_YR, COUNTY, SEG, PRI, CNT, SUM_PRICE, CNT_PRICE, GID"
    return {
        **(llm_queries.oracle_sql() if llm_queries else {}),
        "cube_build": O.with_cube(f"SELECT {cube_cols} FROM tc"),
        "cube_suppress": O.with_cube("SELECT * FROM t"),
        "gid_fingerprint": O.with_cube(
            "SELECT GID, " + ", ".join(f"CASE WHEN max(CAST({c} AS VARCHAR)) IS NOT NULL THEN '{c}' END AS has_{c.lower()}"
                                       for c in O.DIMS) + " FROM d GROUP BY GID"),
        "masked_ratio_by_gid": O.with_cube(
            f"SELECT GID, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE DATA_STATUS = '{O.MASKED}') AS BIGINT) AS n_masked, "
            f"CAST(count(*) FILTER (WHERE DATA_STATUS = '{O.MASKED}') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS masked_ratio FROM d GROUP BY GID"),
        "decode_labels": O.with_cube("SELECT DATA_YR, COUNTY, SEG, PRI, CNT, SUM_PRICE, CNT_PRICE, GID, DATA_STATUS FROM d"),
        "derive_region": O.with_cube("SELECT * FROM d"),
        "unmapped_values": O.with_cube("SELECT DISTINCT COUNTY FROM d WHERE COUNTY IS NOT NULL AND COUNTY NOT IN ("
                                       + ", ".join(O.lit(c) for cs in REGION_COUNTIES.values() for c in cs) + ")"),
        "filter_in_coerced": O.with_cube("SELECT * FROM d WHERE DATA_YR IN (1996, 1997) AND SEG IN ('BUILDING')"),
        "smart_filter": O.with_cube(O.smart_filter("d", "DATA_YR", ["COUNTY"], [], PROBED["filters"])),
        "smart_filter_full": O.with_cube(O.smart_filter("d", "DATA_YR", ["REGION"], [], {}, probe="full")),
        "smart_filter_lazy": O.with_cube(O.smart_filter("d", "DATA_YR", ["COUNTY"], [], PROBED["filters"])),
        "crosstab_cells": O.crosstab(**MAIN, pct=False),
        "crosstab_pct": O.crosstab(**MAIN),
        "crosstab_2x2": O.crosstab(**TWO_BY_TWO),
        "crosstab_nocols": O.crosstab(**NO_COLS),
        "heat_scale": O.with_cube(
            "SELECT DATA_YR, COUNTY, SEG, is_row_total, is_col_total, value, "
            "CASE WHEN NOT is_row_total AND NOT is_col_total THEN CASE WHEN mt = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) / mt END END AS heat_table, "
            "CASE WHEN NOT is_row_total AND NOT is_col_total THEN CASE WHEN mc = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) / mc END END AS heat_col, "
            "CASE WHEN NOT is_row_total AND NOT is_col_total THEN CASE WHEN mr = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) / mr END END AS heat_row "
            "FROM (SELECT *, "
            "max(CASE WHEN NOT is_row_total AND NOT is_col_total THEN CAST(value AS DOUBLE) END) OVER (PARTITION BY DATA_YR) AS mt, "
            "max(CASE WHEN NOT is_row_total AND NOT is_col_total THEN CAST(value AS DOUBLE) END) OVER (PARTITION BY DATA_YR, SEG) AS mc, "
            "max(CASE WHEN NOT is_row_total AND NOT is_col_total THEN CAST(value AS DOUBLE) END) OVER (PARTITION BY DATA_YR, COUNTY) AS mr "
            "FROM cells) c",
            O.crosstab_ctes(**MAIN)),
        "reference_totals": O.with_cube(
            "SELECT DATA_YR, CAST(coalesce(sum(CNT), 0) AS BIGINT) AS ref_total FROM d WHERE DATA_YR IS NOT NULL "
            "AND SEG IN ('BUILDING') AND COUNTY IS NULL AND PRI IS NULL AND REGION IS NULL GROUP BY DATA_YR"),
        "reference_totals_derived": O.with_cube(
            "SELECT DATA_YR, CAST(coalesce(sum(CNT), 0) AS BIGINT) AS ref_total FROM d WHERE DATA_YR IS NOT NULL "
            "AND COUNTY IN ('NATION_1', 'NATION_2') AND SEG IS NULL AND PRI IS NULL GROUP BY DATA_YR"),
        "weighted_avg": O.weighted_avg(**AVG, names=AVG_NAMES),
        "growth_overall": O.growth_overall(**GROWTH),
        "growth_rows": O.growth_series(**GROWTH, by="rows"),
        "growth_cols": O.growth_series(**GROWTH, by="cols"),
        "mean_crosstab": O.with_cube(
            "SELECT COUNTY, SEG, avg(CAST(CNT AS DOUBLE)) AS avg_CNT, avg(CAST(SUM_PRICE AS DOUBLE)) AS avg_SUM_PRICE "
            "FROM d WHERE GID = 0 AND COUNTY IS NOT NULL AND SEG IS NOT NULL GROUP BY COUNTY, SEG"),
        "distinct_values": O.with_cube(" UNION ".join(
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM d WHERE {c} IS NOT NULL"
            for c in ["DATA_YR", "COUNTY", "SEG", "PRI", "REGION"])),
        "drill_summary": O.with_cube(
            "SELECT DATA_YR, CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(CNT), 0) AS BIGINT) AS cnt_sum "
            "FROM f GROUP BY DATA_YR", [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "masked_rows": O.with_cube(f"SELECT * FROM f WHERE DATA_STATUS = '{O.MASKED}'",
                                   [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "masked_detail": O.with_cube(
            "SELECT *, concat_ws(' | ', " + ", ".join(
                f"CASE WHEN {c} IS NOT NULL THEN '{n}: ' || CAST({c} AS VARCHAR) END" for c, n in DETAIL_NAMES.items())
            + f") AS detail FROM f WHERE DATA_STATUS = '{O.MASKED}'",
            [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "tab_order": O.with_cube(
            "SELECT DATA_YR, row_number() OVER (ORDER BY DATA_YR DESC) AS tab_rank FROM (SELECT DISTINCT DATA_YR FROM f)",
            [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "axis_order": O.axis_order(**MAIN, axis="rows", codes_sql=O.NATION_CODES, out="row_rank"),
        "axis_order_cols": O.axis_order(**GROWTH, axis="cols", codes_sql=O.PRI_CODES, out="col_rank"),
        "mix_report": O.mix_report(**MAIN, avg_names=["Average price"]),
        "mix_wide": "SELECT DATA_YR, COUNTY, is_row_total, " + ", ".join(
            f"max(CASE WHEN \"column\" = {O.lit(c)} THEN value END) AS \"{c}\""
            for c in ["全國", "Average price"] + [x for seg in SEGMENTS for x in (seg, seg + "(%)")])
            + " FROM (" + O.mix_report(**MAIN, avg_names=["Average price"]) + ") GROUP BY DATA_YR, COUNTY, is_row_total",
        "report_cells": "\nUNION ALL\n".join(
            O.report_sheet_cells(sp, sh, rk, fo, av) for sp, sh, rk, fo, av, _, _, _ in REPORT_SHEETS),
        "report_notes": "\nUNION ALL\n".join(
            O.report_sheet_note(sp, sh, rk, fo, ch, ti, de, DETAIL_NAMES, _headline(ti)) for sp, sh, rk, fo, _, ch, ti, de in REPORT_SHEETS),
        "preset_table_1": O.preset(["COUNTY"], ["PRI"], "CNT", ["NATION_0", "5-LOW"]),
        "preset_table_2": O.preset(["SEG"], ["PRI"], "SUM_PRICE", ["4-NOT SPECIFIED"]),
        "preset_batch": "\nUNION ALL\n".join(
            f"SELECT {O.lit(n)} AS name, CAST(CASE WHEN is_row_total THEN NULL ELSE {r} END AS VARCHAR) AS row_key, "
            f"CAST(CASE WHEN is_col_total THEN NULL ELSE {c} END AS VARCHAR) AS col_key, is_row_total, is_col_total, "
            f"CAST(value AS DOUBLE) AS value, row_pct, col_pct, total_pct FROM ({O.preset([r], [c], v, x)})"
            for n, r, c, v, x in [("Table 1-1", "COUNTY", "PRI", "CNT", ["NATION_0", "5-LOW"]),
                                  ("Table 1-2", "SEG", "PRI", "SUM_PRICE", ["4-NOT SPECIFIED"])]),
        "toc": " UNION ALL ".join(
            f"SELECT {O.lit(ch)} AS chapter, {O.lit(ti)} AS title, {O.lit(chr(39).join(['internal:', sh, '!A1']))} AS link, {O.lit(sh)} AS sheet, "
            f"CAST({rk} AS BIGINT) AS sheet_rank"
            for ch, ti, sh, rk in [(ch, ti, sh, rk) for _, sh, rk, _, _, ch, ti, _ in REPORT_SHEETS] + [("x", "Unknown column ", "x", 5)]),
        "report_errors": "SELECT 'x' AS \"Chapter\", 'Unknown column' AS \"Name\", "
                         "'ValueError: columns not in the cube: [''NOPE'']' AS \"Error\"",
        "mix_nocols": O.mix_nocols("DATA_YR", ["COUNTY"], "SUM_PRICE", NO_COLS["filters"]),
        "cube_with_gaps": O.CUBE_WITH_GAPS,
        "catalog_enabled": O.catalogue(DELIVERED, DISABLED, DATASET_PREFIXES),
        "delivery_inferred": O.delivery_inferred(),
        "path_functions": "SELECT c_custkey, c_mktsegment || '_coded_' || c_custkey || '.v1.parquet' AS base, c_mktsegment || '_coded_' || c_custkey || '.v1' AS stem, "
                          "'260204/' || c_mktsegment || '_coded_' || c_custkey || '.v1.parquet' AS below_data, c_mktsegment AS prefix, "
                          "c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND regexp_full_match(c_name, '[0-9]+')) AS is_number, "
                          "strftime(to_timestamp(c_custkey * 86399) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified FROM customer",
        "distinct_values_sorted": O.with_cube(" UNION ".join(
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM d WHERE {c} IS NOT NULL" for c in ["DATA_YR", "SEG"])),
        "number_formats": "SELECT c_mktsegment, format('{:,}', cents) AS whole, format('{:,.2f}', cents / 100) AS decimal2, "
                          "format('{:,.2f}', n / 1000) || '%' AS percent FROM (SELECT c_mktsegment, count(*) AS n, "
                          "CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer GROUP BY 1)",
        "columns_reordered": O.with_cube("SELECT REGION, CNT, DATA_YR, COUNTY, SEG, PRI, SUM_PRICE, CNT_PRICE, GID, DATA_STATUS FROM d"),
        "crosstab_with_gaps": O.CROSSTAB_WITH_GAPS,
        "mix_blocks": "SELECT DATA_YR, COUNTY, is_row_total, CAST(floor(col_order / 5) AS BIGINT) AS block, string_agg(\"column\", '|' ORDER BY col_order) AS names, "
                      "CAST(count(*) AS BIGINT) AS n, min(value) AS least, max(value) AS most, arg_min(value, col_order) AS first FROM ("
                      + O.mix_report(**MAIN, avg_names=["Average price"]) + ") GROUP BY ALL",
        "probe_index": O.with_cube("SELECT DISTINCT a AS aggregated, u.dim, u.value FROM (SELECT "
                                   + " + ".join(f"CASE WHEN {c} IS NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(O.DIMS))
                                   + " AS a, * FROM d) x, LATERAL (VALUES (NULL, NULL), "
                                   + ", ".join(f"(CASE WHEN {c} IS NOT NULL THEN '{c}' END, CAST({c} AS VARCHAR))" for c in O.DIMS) + ") AS u(dim, value)"),
        "smart_filter_indexed": O.with_cube(O.smart_filter("d", "DATA_YR", ["COUNTY"], [], PROBED["filters"])),
        "report_indexed": "\nUNION ALL\n".join(
            O.report_sheet_note(sp, sh, rk, fo, ch, ti, de, DETAIL_NAMES, _headline(ti)) for sp, sh, rk, fo, _, ch, ti, de in REPORT_SHEETS),
        "report_failures": O.with_cube(
            "SELECT '1' AS \"Chapter\", 'Overlap' AS \"Name\", 'ValueError: row and column dimensions overlap: [''COUNTY'']' AS \"Error\", CAST(NULL AS BIGINT) AS total "
            "UNION ALL SELECT '2', 'No such source', 'FileNotFoundError: Data file not found: no_such_cube', NULL "
            "UNION ALL SELECT '3', 'Sum of text', 'NumberFormatException: [CAST_INVALID_INPUT] The value ''BUILDING'' of the type \"STRING\" cannot be cast to \"DOUBLE\"', NULL "
            "UNION ALL SELECT '4', 'Good ', '', (SELECT CAST(sum(CNT) AS BIGINT) FROM d WHERE DATA_YR = 1997 AND COUNTY IS NULL AND SEG = 'BUILDING' AND PRI IS NULL)"),
        "growth_guard": "SELECT 'YEAR' AS tab_dim, CAST(DATA_YR AS VARCHAR) AS tab, TOTAL, YEARLY_GROWTH, YEARLY_GROWTH_PCT FROM ("
                        + O.growth_overall(**{**GROWTH, "filters": {}, "cols": ["SEG"]}) + ")",
        "reference_rows": O.with_cube(f"SELECT * FROM d WHERE {O.reference_where('DATA_YR', ['COUNTY'], [], REF['filters'])} AND DATA_YR = 1997"),
        "delivery_csv": "SELECT * FROM part",
        "region_static": "SELECT CASE c_nationkey " + " ".join(f"WHEN {i} THEN {O.lit(r)}" for i, (_, r) in enumerate(COUNTIES))
                         + " ELSE '未分類區域' END AS \"REGION\", CAST(count(*) AS BIGINT) AS n_orders, "
                           "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents "
                           "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "coarse_bins": "WITH r AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CASE WHEN c_nationkey < 10 THEN '0-9' WHEN c_nationkey < 20 "
                       "THEN '10-19' ELSE '20-24' END AS b FROM orders JOIN customer ON o_custkey = c_custkey), "
                       "g AS (SELECT y AS \"DATA_YR\", b AS \"COUNTY\", GROUPING(b) = 1 AS is_row_total, CAST(count(*) AS BIGINT) AS value "
                       "FROM r GROUP BY GROUPING SETS ((y, b), (y))) "
                       "SELECT \"DATA_YR\", \"COUNTY\", is_row_total, t AS is_col_total, value FROM g, (VALUES (TRUE), (FALSE)) AS v(t)",
        "lineitem_crosstab": O.lineitem_crosstab(**LINEITEM_XT),
        "events_crosstab": O.events_crosstab(**EVENTS_XT),
        "events_weighted_avg": O.events_weighted_avg(**EVENTS_XT, names=["Average value"]),
        "distinct_gids": O.with_cube("SELECT DISTINCT GID FROM d"),
        "growth_summary": "SELECT avg(YEARLY_GROWTH_PCT) AS mean_growth_pct, "
                          "arg_max(YEARLY_GROWTH_PCT, DATA_YR) AS latest_growth_pct FROM (" + O.growth_overall(**GROWTH) + ")",
        "tab_slice": O.with_cube("SELECT * FROM f WHERE CAST(DATA_YR AS VARCHAR) = '1997'",
                                 [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "preview_rows": O.with_cube(
            "SELECT * FROM f WHERE CAST(DATA_YR AS VARCHAR) = '1997' ORDER BY " + ", ".join(
                f"{c} ASC NULLS FIRST" for c in ["DATA_YR", "COUNTY", "SEG", "PRI", "CNT", "SUM_PRICE", "CNT_PRICE",
                                                  "GID", "DATA_STATUS", "REGION"]) + " LIMIT 100",
            [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "display_names": O.with_cube(
            'SELECT DATA_YR AS "Order year", COUNTY AS "Nation", SEG AS "Market segment", PRI AS "Priority", CNT, '
            'SUM_PRICE, CNT_PRICE, GID, DATA_STATUS, REGION AS "Region" FROM d'),
        "distinct_tabs": O.with_cube("SELECT DISTINCT DATA_YR FROM f WHERE DATA_YR IS NOT NULL",
                                     [("f", O.smart_filter("d", "DATA_YR", ["COUNTY"], ["SEG"], {}))]),
        "grouping_set_rows": O.with_cube("SELECT * FROM d WHERE GID = 3"),
        "published_rows": O.with_cube(f"SELECT * FROM d WHERE DATA_STATUS = '{O.NORMAL}'"),
        "sql_gid_fingerprint": O.with_cube(
            "SELECT GID, " + ", ".join(f"CASE WHEN max(CAST({c} AS VARCHAR)) IS NOT NULL THEN '{c}' END AS has_{c.lower()}"
                                       for c in O.DIMS) + " FROM d GROUP BY GID"),
    }
