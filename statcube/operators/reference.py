"""Reference (parent) totals: the published, unsuppressed count behind each
tab of a crosstab, read from the cube's own subtotal rows rather than summed
from (possibly suppressed) leaves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statcube.operators.filters import Marker, as_list, is_null, reference_rows
from statcube.schema import COUNT_COL


def reference_totals(cube: DataFrame, tab: str, rows: str | Sequence[str], cols: str | Sequence[str] = (),
                     filters: Mapping[str, Sequence] | None = None, derived: Mapping[str, str] | None = None,
                     count_col: str = COUNT_COL, marker: Marker = is_null) -> DataFrame:
    """(tab, ref_total) = sum of CNT over the parent rows, whatever metric the
    crosstab sums. Tabs without a parent row are absent (consumers show 0)."""
    parents = reference_rows(cube, tab, as_list(rows), as_list(cols), filters, derived, marker)
    return parents.groupBy(tab).agg(F.coalesce(F.sum(count_col), F.lit(0)).cast("long").alias("ref_total"))
