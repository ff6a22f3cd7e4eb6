"""Growth between tabs (period over period), from crosstab totals.

* overall: grand total per tab, growth = cur/prev - 1 in ascending tab order;
  the first tab and 0/0 give 0, x/0 gives inf; also ×100.
* per row key / per column key (totals included): for every tab but the
  first, growth % = (cur/prev - 1) × 100, where a tab without a value takes that
  of the last tab that had one; a key seen only from a later tab on has NULL
  before it, 0 -> x is inf, 0 -> 0 NULL. The values of a key become one array
  sorted by tab; each tab, with the tab before it, looks its two values up there:
  no window over the cells, and no table of absent ones.

Growth is defined for the year tab, and for a tab whose first value is a number;
otherwise the result is empty with the same schema. Tabs that are no numbers
are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import ratio_inf
from statcube.operators.crosstab import COL_TOTAL, ROW_TOTAL, VALUE, key_grid
from statcube.operators.filters import as_list
from statcube.operators.ordering import ranked
from statcube.schema import YEAR_TAB
from statcube.session import cut_lineage


def _tab_number(tab: str) -> Column:
    return F.col(tab).cast("string").try_cast(T.DoubleType())


def allows_growth(df: DataFrame, tab: str) -> bool:
    """Growth guard: the year tab, or a first tab that is a number."""
    if tab == YEAR_TAB or isinstance(df.schema[tab].dataType, T.NumericType):
        return True
    first = df.agg(F.min(F.col(tab).cast("string")).alias(tab)).select(_tab_number(tab)).first()
    return first[0] is not None


def overall_growth(cells: DataFrame, tab: str) -> DataFrame:
    """tab, TOTAL, YEARLY_GROWTH, YEARLY_GROWTH_PCT (one row per tab)."""
    totals = cells.where(F.col(ROW_TOTAL) & F.col(COL_TOTAL)).select(tab, F.col(VALUE).alias("TOTAL"))
    totals = totals.where(_tab_number(tab).isNotNull() if allows_growth(totals, tab) else F.lit(False))
    held = cut_lineage(ranked(totals, [], [_tab_number(tab)], "_rank"))
    before = held.select((F.col("_rank") + 1).alias("_rank"), F.col("TOTAL").alias("_prev"))
    prev = F.col("_prev")
    growth = F.when(prev.isNull(), F.lit(0.0)).otherwise(
        ratio_inf(F.col("TOTAL"), prev, zero_over_zero=F.lit(1.0)) - F.lit(1.0))
    return (held.join(before, "_rank", "left").select(tab, "TOTAL", growth.alias("YEARLY_GROWTH"))
            .withColumn("YEARLY_GROWTH_PCT", F.col("YEARLY_GROWTH") * 100))


def tab_steps(tabs: DataFrame, tab: str) -> DataFrame:
    """(tab, _at, _before): each tab but the first with its number and that of
    the tab before it."""
    held = cut_lineage(ranked(tabs.select(tab).distinct(), [], [_tab_number(tab)], "_rank").withColumn("_at", _tab_number(tab)))
    before = held.select((F.col("_rank") + 1).alias("_rank"), F.col("_at").alias("_before"))
    return held.join(before, "_rank").select(tab, "_at", "_before")


def series_growth(src: DataFrame, tab: str, keys: Sequence[str], value: str = VALUE, absent: str = "carry") -> DataFrame:
    """Growth % per key and tab; an absent value is the last one before it
    (``absent="carry"``) or zero (``"zero"``).

    ``src`` has at most one row per (tab, keys). Output: tab, keys…, growth_pct.
    """
    keys = list(keys)
    out_schema = T.StructType([src.schema[tab], *[src.schema[k] for k in keys],
                               T.StructField("growth_pct", T.DoubleType())])
    if not allows_growth(src, tab):
        return src.sparkSession.createDataFrame([], out_schema)
    src = src.where(_tab_number(tab).isNotNull())
    series = src.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(_tab_number(tab).alias("t"), F.col(value).alias("v")))).alias("_series"))
    steps = key_grid(series, tab_steps(src, tab))

    def last_value(at: str) -> Column:
        last = F.try_element_at(F.filter("_series", lambda x: x["t"] <= F.col(at)), F.lit(-1))
        if absent == "zero":
            return F.when(last["t"] == F.col(at), last["v"]).otherwise(F.lit(0).cast(src.schema[value].dataType))
        return last["v"]

    growth = (ratio_inf(last_value("_at"), last_value("_before")) - F.lit(1.0)) * F.lit(100.0)
    return steps.select(tab, *keys, growth.alias("growth_pct"))


def row_growth(cells: DataFrame, tab: str, rows: str | Sequence[str]) -> DataFrame:
    """Growth % of each row total (total row included) between tabs."""
    rows = as_list(rows)
    src = cells.where(F.col(COL_TOTAL)).select(tab, *rows, ROW_TOTAL, VALUE)
    return series_growth(src, tab, [*rows, ROW_TOTAL])


def col_growth(cells: DataFrame, tab: str, cols: str | Sequence[str]) -> DataFrame:
    """Growth % of each column total (total column included) between tabs; a
    column that is absent from a tab counts as zero there."""
    cols = as_list(cols)
    src = cells.where(F.col(ROW_TOTAL)).select(tab, *cols, COL_TOTAL, VALUE)
    return series_growth(src, tab, [*cols, COL_TOTAL], absent="zero")


def growth_summary(overall: DataFrame, tab: str) -> DataFrame:
    """Mean growth % and the latest tab's growth %."""
    return overall.agg(F.avg("YEARLY_GROWTH_PCT").alias("mean_growth_pct"),
                       F.max_by("YEARLY_GROWTH_PCT", _tab_number(tab)).alias("latest_growth_pct"))
