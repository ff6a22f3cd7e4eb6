"""Saved report specs as a DataFrame: read (JSON lines), cleaned, with the
stored text filters parsed into ``map<string, array<string>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.schema import REPORT_SPEC_SCHEMA

TEXT_FIELDS = ["chapter", "name", "unit", "description", "timestamp", "data_source", "filters",
               "pivot_tab", "pivot_sum"]


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specs as JSON lines with a fixed schema (no inference)."""
    return spark.read.schema(REPORT_SPEC_SCHEMA).json(path)


def specs_frame(spark: SparkSession, specs: list[dict]) -> DataFrame:
    rows = [{f.name: s.get(f.name) for f in REPORT_SPEC_SCHEMA.fields} for s in specs]
    return spark.createDataFrame(rows, REPORT_SPEC_SCHEMA)


def clean_specs(specs: DataFrame) -> DataFrame:
    """Drop specs without a data source (NULL, '' or 'None'); add missing text
    fields; NULL text -> '' except the focus tab."""
    out = specs
    for f in TEXT_FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, F.lit(""))
    ds = F.trim(F.col("data_source"))
    out = out.where(ds.isNotNull() & (ds != "") & (ds != "None"))
    return out.na.fill("", subset=[f for f in TEXT_FIELDS])


def parse_filters(text: str | Column) -> Column:
    """Stored filter text such as {'COL': ('a', 'b')} -> map<string,
    array<string>>; unparseable or missing -> empty map."""
    c = F.col(text) if isinstance(text, str) else text
    as_json = F.regexp_replace(F.translate(c, "()'", '[]"'), r",\s*\]", "]")
    parsed = F.from_json(as_json, "map<string,array<string>>")
    return F.coalesce(parsed, F.create_map().cast("map<string,array<string>>"))
