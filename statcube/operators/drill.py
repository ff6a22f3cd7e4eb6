"""Drill-through: the rows behind a tab, their summary, suppressed-cell
details, and distinct values for filter pickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statcube.operators.filters import rows_of_tab
from statcube.schema import COUNT_COL, dimension_columns
from statcube.sources.codebook import Codebook

PREVIEW_ROWS = 1000


def drill_summary(filtered: DataFrame, tab: str, count_col: str = COUNT_COL) -> DataFrame:
    """Per tab: number of cube rows behind the crosstab and their CNT sum."""
    return filtered.groupBy(tab).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.coalesce(F.sum(count_col), F.lit(0)).cast("long").alias("cnt_sum"))


def preview(filtered: DataFrame, tab: str, value, order_by: list[str] | None = None,
            n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of one tab in a stable order (the preview is a top-n
    feature; the full slice stays available as a lazy DataFrame)."""
    rows = rows_of_tab(filtered, tab, value)
    keys = order_by or [c for c in filtered.columns]
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in keys]).limit(n)


def distinct_tabs(filtered: DataFrame, tab: str) -> DataFrame:
    return filtered.select(tab).where(F.col(tab).isNotNull()).distinct()


def distinct_values(df: DataFrame, columns: list[str] | None = None, sort: bool = False) -> DataFrame:
    """(column, value) for the distinct non-null values of the columns (default:
    the dimensions), as text. One pass: the columns are stacked into one long relation and a
    distributed distinct (partial aggregation first) removes duplicates.
    ``sort``: ordered by column, then value as text (a distributed sort)."""
    cols = columns or dimension_columns(df)
    stacked = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                 for c in cols]))
    out = df.select(stacked).where(F.col("value").isNotNull()).distinct()
    return out.orderBy("column", "value") if sort else out


def masked_detail(masked: DataFrame, codebook: Codebook | None = None) -> DataFrame:
    """For each suppressed row: 'name: value | name: value' over its non-null
    dimensions, in schema order, with display names."""
    names = codebook.display_names() if codebook is not None else {}
    parts = [F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{names.get(d, d)}: "), F.col(d).cast("string")))
             for d in dimension_columns(masked)]
    return masked.select("*", F.concat_ws(" | ", *parts).alias("detail"))
