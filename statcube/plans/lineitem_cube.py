"""A second cube, from ``lineitem``: shipped quantity by ship year, return
flag and line status (no join; the builder's partial aggregation works on the
raw rows directly)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.operators.cube import build_cube, flag_suppressed, layout_of
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook
from statcube.sources.tables import read_table

SECTION = {
    "DATA_YR": {"name": "Ship year", "group_type": "fixed"},
    "FLAG": {"name": "Return flag", "group_type": "grouping_set"},
    "LSTATUS": {"name": "Line status", "group_type": "grouping_set",
                "avg": {"name": "Average quantity", "num": "SUM_QTY", "den": "CNT_QTY"}},
}


def cube(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("DATA_YR"), F.col("l_returnflag").alias("FLAG"),
        F.col("l_linestatus").alias("LSTATUS"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    out = flag_suppressed(build_cube(rows, **layout_of(codebook().group_types()), metrics={
        "CNT": F.count(F.lit(1)), "SUM_QTY": F.sum("qty"), "CNT_QTY": F.count("qty")}))
    out = out.withColumn("SUM_QTY", F.col("SUM_QTY").cast("double"))  # summed exactly
    return cut_lineage(out) if materialize else out


def codebook() -> Codebook:
    return Codebook(dict(SECTION))
