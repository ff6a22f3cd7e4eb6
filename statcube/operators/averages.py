"""Weighted averages per crosstab row and for the total row.

For each COLUMN dimension whose codebook entry defines ``avg: {num, den}``:
average = sum(num) / sum(den) per tab × row key, and per tab for the total
row. Row rule: 0/0 -> 0, x/0 -> ±inf; total-row rule: den = 0 -> 0. If any
numerator or denominator column is missing, there are no averages.

One grouping-sets aggregate computes the rows and the total row together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import ratio_inf, ratio_or_zero
from statcube.operators.filters import as_list
from statcube.sources.codebook import AvgSpec, Codebook

ROW_TOTAL = "is_row_total"


def avg_specs(codebook: Codebook, cols: Sequence[str]) -> list[AvgSpec]:
    seen, out = set(), []
    for c in as_list(cols):
        spec = codebook.avg_spec(c)
        if spec is not None and spec.name not in seen:
            seen.add(spec.name)
            out.append(spec)
    return out


def _empty(filtered: DataFrame, tab: str, rows: Sequence[str]) -> DataFrame:
    fields = [filtered.schema[tab], *[filtered.schema[r] for r in rows],
              T.StructField(ROW_TOTAL, T.BooleanType()), T.StructField("avg_name", T.StringType()),
              T.StructField("avg_value", T.DoubleType())]
    return filtered.sparkSession.createDataFrame([], T.StructType(fields))


def weighted_averages(filtered: DataFrame, tab: str, rows: str | Sequence[str], cols: str | Sequence[str],
                      codebook: Codebook) -> DataFrame:
    """Long table: tab, row dims…, is_row_total, avg_name, avg_value."""
    rows = as_list(rows)
    specs = avg_specs(codebook, cols)
    needed = list(dict.fromkeys(x for s in specs for x in (s.num, s.den)))
    if not specs or any(c not in filtered.columns for c in needed):
        return _empty(filtered, tab, rows)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in needed]
    g = filtered.groupingSets([[tab, *rows], [tab]], tab, *rows).agg(*sums, F.grouping(rows[0]).alias("_gr"))
    is_total = F.col("_gr") == 1
    per_spec = [F.struct(F.lit(s.name).alias("avg_name"),
                         F.when(is_total, ratio_or_zero(s.num, s.den))
                          .otherwise(ratio_inf(s.num, s.den, zero_over_zero=F.lit(0.0))).alias("avg_value"))
                for s in specs]
    return g.select(tab, *rows, is_total.alias(ROW_TOTAL), F.inline(F.array(*per_spec)))
