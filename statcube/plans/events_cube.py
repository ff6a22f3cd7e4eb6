"""A third cube, from ``events``: events by ISO year and week (as 202401), event type and 6-hour
band of the day, with the event value summed in cents (no join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.operators.cube import build_cube, flag_suppressed, layout_of
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook
from statcube.sources.tables import read_table

SECTION = {
    "WEEK": {"name": "Week", "group_type": "fixed"},
    "EVENT": {"name": "Event type", "group_type": "grouping_set"},
    "BAND": {"name": "Hour band", "group_type": "grouping_set",
             "codes": {0: "00-05", 1: "06-11", 2: "12-17", 3: "18-23"},
             "avg": {"name": "Average value", "num": "SUM_VALUE", "den": "CNT_VALUE"}},
}


def cube(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(
        (F.extract(F.lit("YEAROFWEEK"), F.col("ts")) * 100 + F.weekofyear("ts")).cast("long").alias("WEEK"), F.col("event_type").alias("EVENT"),
        F.floor(F.hour("ts") / 6).cast("int").alias("BAND"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = flag_suppressed(build_cube(rows, **layout_of(codebook().group_types()), metrics={
        "CNT": F.count(F.lit(1)), "SUM_VALUE": F.sum("cents"), "CNT_VALUE": F.count("cents")}))
    return cut_lineage(out) if materialize else out


def codebook() -> Codebook:
    return Codebook(dict(SECTION))
