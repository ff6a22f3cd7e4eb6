"""Report layout of one tab: the MIX view as long report cells.

Columns of the MIX view, in order: the total column, the weighted averages,
then for every column key ``c`` its value and ``c(%)`` (row percent). Each
report cell carries its column label, kind, display format class and column
position; ``to_wide`` pivots them into the sheet layout at the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statcube.functions import format_class
from statcube.operators.crosstab import COL_TOTAL, ROW_TOTAL, VALUE, attach, label_totals
from statcube.operators.filters import as_list
from statcube.operators.ordering import axis_order
from statcube.schema import TOTAL_LABEL
from statcube.sources.codebook import Codebook

PCT_SUFFIX = "(%)"


def column_label(cols: Sequence[str]) -> Column:
    """Text of a column key: the label itself, or a tuple text for two levels."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    inner = F.concat_ws("', '", *[F.col(c).cast("string") for c in cols])
    return F.concat(F.lit("('"), inner, F.lit("')"))


def mix_cells(cells: DataFrame, averages: DataFrame, tab: str, rows: Sequence[str], cols: Sequence[str],
              codebook: Codebook | None = None, avg_names: Sequence[str] = (), metric: str = VALUE,
              totals: DataFrame | None = None) -> DataFrame:
    """Long MIX cells: tab, row labels…, is_row_total, column, kind, value,
    col_order, format. ``cells`` must carry ``row_pct``; it is read once where
    ``totals`` (the stored sparse cells) has the total column and the column
    keys. Without column dimensions the one value column has the name of the
    metric."""
    rows, cols = as_list(rows), as_list(cols)
    head = [tab, *rows, ROW_TOTAL]
    totals = cells if totals is None else totals
    total = totals.where(F.col(COL_TOTAL)).select(
        *head, F.lit(TOTAL_LABEL).alias("column"), F.lit("value").alias("kind"),
        F.col(VALUE).cast("double").alias("value"), F.lit(0).cast("long").alias("col_order"))
    n_avg = len(avg_names)
    parts = [total]
    if avg_names:
        pos = F.create_map(*[x for i, n in enumerate(avg_names) for x in (F.lit(n), F.lit(i + 1))])
        parts.append(averages.select(*head, F.col("avg_name").alias("column"), F.lit("avg").alias("kind"),
                                     F.col("avg_value").alias("value"),
                                     F.try_element_at(pos, F.col("avg_name")).cast("long").alias("col_order")))
    if cols:
        # one position per column key of the whole table, the total first
        keys = totals.where(F.col(ROW_TOTAL)).select(F.lit(0).alias("_all"), *cols, COL_TOTAL).distinct()
        ranks = axis_order(keys, "_all", cols, COL_TOTAL, codebook, "__crank")
        inner = attach(cells.where(~F.col(COL_TOTAL)), ranks.where(~F.col(COL_TOTAL)).drop(COL_TOTAL, "_all"), cols)
        base = (F.lit(n_avg) + (F.col("__crank") - 2) * 2 + 1).cast("long")
        parts.append(inner.select(*head, _value_and_percent(column_label(cols), base)))
    else:
        parts.append(cells.where(~F.col(COL_TOTAL)).select(*head, _value_and_percent(F.lit(metric), F.lit(n_avg + 1).cast("long"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = label_totals(out, rows, [])
    return out.withColumn("format", format_class(F.col("column")))


def _value_and_percent(label: Column, place: Column) -> Column:
    """Two report cells of one crosstab cell."""
    return F.inline(F.array(
        F.struct(label.alias("column"), F.lit("value").alias("kind"), F.col(VALUE).cast("double").alias("value"), place.alias("col_order")),
        F.struct(F.concat(label, F.lit(PCT_SUFFIX)).alias("column"), F.lit("pct").alias("kind"), F.col("row_pct").alias("value"),
                 (place + 1).alias("col_order"))))


# Columns of one block of a wide sheet.
BLOCK_COLUMNS = 1000


def column_blocks(mix: DataFrame, block: int = BLOCK_COLUMNS) -> DataFrame:
    """(block, columns): the columns of each block in order, as an array of
    (col_order, name). Columns are told apart by their position, so a label
    equal to another in its block keeps its own column: the later one gets its
    position after its name."""
    place = F.floor(F.col("col_order") / block).cast("long")
    found = mix.select("col_order", "column").groupBy("col_order").agg(F.min("column").alias("column"))
    first = F.row_number().over(Window.partitionBy("block", F.lower("column")).orderBy("col_order")) == 1
    named = found.withColumn("block", place).withColumn(
        "name", F.when(first, F.col("column")).otherwise(F.concat("column", F.lit(" #"), F.col("col_order").cast("string"))))
    return named.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("col_order", "name"))).alias("columns"))


def sheet_blocks(mix: DataFrame, index: Sequence[str], block: int = BLOCK_COLUMNS) -> DataFrame:
    """(index…, block, names, values): each row of a sheet, cut into blocks of
    columns; ``values`` holds one value per name (NULL where the row has none).
    A sheet of any width: no task or driver holds more than a block of a row."""
    placed = mix.select(*index, F.floor(F.col("col_order") / block).cast("long").alias("block"), "col_order", "value")
    rows = placed.groupBy(*index, "block").agg(F.map_from_entries(F.collect_list(F.struct("col_order", "value"))).alias("_cells"))
    joined = rows.join(column_blocks(mix, block), "block")
    return joined.select(*index, "block", F.transform("columns", lambda c: c["name"]).alias("names"),
                         F.transform("columns", lambda c: F.try_element_at(F.col("_cells"), c["col_order"])).alias("values"))


def write_wide(mix: DataFrame, index: Sequence[str], path: str, block: int = BLOCK_COLUMNS) -> None:
    """The sheet at ``path``, one folder of files per block of columns."""
    sheet_blocks(mix, index, block).repartition("block", *index).write.mode("overwrite").partitionBy("block").parquet(path)


def to_wide(mix: DataFrame, index: Sequence[str], block: int = BLOCK_COLUMNS) -> DataFrame:
    """Sheet layout: one row per row key, one column per report column, in
    column order. A table can have so many columns only: a sheet wider than
    a block is an error (``write_wide`` takes any)."""
    found = column_blocks(mix.where(F.col("col_order").isNotNull()), block).limit(2).collect()  # two blocks of names at most
    if len(found) > 1 or (found and found[0]["block"] != 0):
        raise ValueError(f"the sheet has more than {block} columns: write it in blocks")
    cells = mix.groupBy(*index).agg(F.map_from_entries(F.collect_list(F.struct("col_order", "value"))).alias("_cells"))
    taken = {i.lower() for i in index}
    names = [(p, n if n.lower() not in taken else f"{n} #{p}") for p, n in (found[0]["columns"] if found else [])]
    return cells.select(*index, *[F.try_element_at("_cells", F.lit(p)).alias(n) for p, n in names])


def reorder_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Listed columns (those present) first, in the listed order, then the rest."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
