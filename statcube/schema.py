"""Cube data model: which columns are dimensions, which are metrics, and the
fixed labels a statistical cube carries.

A cube row is one cell of a GROUPING SETS result. A NULL in a dimension means
"aggregated over this dimension" (a subtotal); metrics are additive.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# These must equal the values used by existing cube deliveries and reports, so
# they are stated here once, as plain text.
METRIC_PREFIXES = ("CNT_", "SUM_", "AVG_", "PCT_")
METRIC_COLUMNS = frozenset({"DATA_STATUS", "CNT", "GID", ""})
TOTAL_LABEL = "全國"            # label of the total row / column
MASKED = "遮蔽"                 # suppressed cell
NORMAL = "正常"                 # published cell
SUPPRESS_BELOW = 3             # a cell with fewer rows than this is suppressed
UNMAPPED_REGION = "未分類區域"   # region of a county that no region lists
AVG_PREFIX = "平均"             # default weighted-average name prefix
YEAR_TAB = "DATA_YR"            # the tab that sorts descending and always allows growth
STATUS_COL = "DATA_STATUS"
COUNT_COL = "CNT"
GID_COL = "GID"
# -----------------------------------------------------------------------------


def is_metric(name: str) -> bool:
    """A column is a metric (or bookkeeping column) by its name alone."""
    return name.startswith(METRIC_PREFIXES) or name in METRIC_COLUMNS


def is_unnamed(name: str) -> bool:
    """Index columns that spreadsheet tools write without a name: an empty header,
    'Unnamed: <position>', or the name a CSV reader gives the first column then."""
    return name in ("", "_c0") or re.fullmatch(r"Unnamed: \d+", name) is not None


def dimension_columns(df: DataFrame | T.StructType) -> list[str]:
    """Dimension columns in schema order (the order the probe filter relies on)."""
    schema = df.schema if isinstance(df, DataFrame) else df
    return [f.name for f in schema.fields if not is_metric(f.name)]


# Report spec as stored by the batch report job (one JSON object per line).
REPORT_SPEC_SCHEMA = T.StructType([
    T.StructField("chapter", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("focus_tab", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("data_source", T.StringType()),
    T.StructField("filters", T.StringType()),
    T.StructField("pivot_row", T.ArrayType(T.StringType())),
    T.StructField("pivot_col", T.ArrayType(T.StringType())),
    T.StructField("pivot_tab", T.StringType()),
    T.StructField("pivot_sum", T.StringType()),
])
