"""Crosstab cells with totals and percentages, as a long table.

Shape (one row per cell):
``tab, row dims…, col dims…, is_row_total, is_col_total, value`` — the
total row has NULL row keys and ``is_row_total``; the total column has NULL
column keys and ``is_col_total``. The text label of totals is applied only at
the sink (``label_totals``), so a data label equal to it cannot collide.

Semantics: the row space of a tab is the rows seen in that tab; the column
space is every column key seen in any tab; absent cells are 0; totals are
sums of the visible cells.

Plan: one grouping-sets aggregate over the filtered rows (partial aggregation
before the shuffle) yields the cells that are present and all totals
(``sparse_cells``), and is written once; it has the size of the output, not of
the cube. Everything else reads that table: zero cells are added last
(``densify``), and percentages and colour scales join totals back by key. No
window spans a column or a tab.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statcube.functions import all_not_null, safe_div
from statcube.operators.filters import as_list
from statcube.schema import TOTAL_LABEL
from statcube.session import cut_lineage

ROW_TOTAL, COL_TOTAL, VALUE, ROW_PCT = "is_row_total", "is_col_total", "value", "row_pct"


# Column keys of one block, and row keys that meet a block in one join group.
BLOCK_KEYS, SALT_ROWS = 1024, 16384


def key_grid(left: DataFrame, right: DataFrame, on: Sequence[str] = (), block: int = BLOCK_KEYS,
             salt_rows: int = SALT_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` (distinct keys; the
    columns of a sheet, or its tabs) that has the same ``on``.

    The keys of ``right`` are dealt into blocks of about ``block`` keys, an array
    each, and a left row goes to every block (by number). They meet by an
    equi-join on block and salt, with a salt for each ``salt_rows`` left rows, so
    neither many columns nor many rows land in one task. Only the two counts are
    scalars (or known: ``sizes``, upper bounds of the rows of ``left`` and
    ``right``); a list of keys never is.
    """
    on = list(on)
    keys = [c for c in right.columns if c not in on]
    h = F.xxhash64(*[F.col(c) for c in keys])
    place = [*on, "_block", "_salt"]
    if on:
        n = (right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")).join(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")), on)
             .select(*on, _parts("_r", block).alias("_blocks"), _parts("_l", salt_rows).alias("_salts")))
        left_n, right_n = left.join(n, on), right.join(n, on)
    elif sizes is not None:
        n_left, n_right = (max(1, -(-n // size)) for n, size in zip(sizes, (salt_rows, block)))
        known = {"_blocks": F.lit(n_right).cast("long"), "_salts": F.lit(n_left).cast("long")}
        left_n, right_n = left.withColumns(known), right.withColumns(known)
    else:
        blocks = right.agg(_parts(F.count(F.lit(1)), block)).scalar()
        salts = left.agg(_parts(F.count(F.lit(1)), salt_rows)).scalar()
        left_n, right_n = (d.withColumns({"_blocks": blocks, "_salts": salts}) for d in (left, right))
    dealt = (right_n.withColumn("_block", F.pmod(h, F.col("_blocks"))).groupBy(*on, "_block", "_salts")
             .agg(F.collect_list(F.struct(*keys)).alias("_keys"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts"))
    own = (left_n.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.col("_salts")))
           .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks", "_salts"))
    return own.join(dealt, place).select(*left.columns, F.inline("_keys"))


def _parts(count: str | Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil((F.col(count) if isinstance(count, str) else count) / size).cast("long"))


def sparse_cells(filtered: DataFrame, tab: str, rows: str | Sequence[str], cols: str | Sequence[str],
                 metric: str) -> DataFrame:
    """Cells that are present, and all totals, of sum(metric) by tab x rows x cols."""
    rows, cols = as_list(rows), as_list(cols)
    if not rows:
        raise ValueError("a crosstab needs at least one row dimension")
    src = filtered.select(tab, *rows, *cols, F.col(metric).alias("_v"))
    total = F.coalesce(F.sum("_v"), F.lit(0).cast(src.schema["_v"].dataType)).alias(VALUE)
    if cols:
        sets = [[tab, *rows, *cols], [tab, *rows], [tab, *cols], [tab]]
        g = src.groupingSets(sets, tab, *rows, *cols).agg(total, F.grouping(rows[0]).alias("_gr"), F.grouping(cols[0]).alias("_gc"))
        return g.select(tab, *rows, *cols, (F.col("_gr") == 1).alias(ROW_TOTAL), (F.col("_gc") == 1).alias(COL_TOTAL), VALUE)
    # No column dims: one value column (the metric) plus the total column,
    # which carries the same number.
    g = src.groupingSets([[tab, *rows], [tab]], tab, *rows).agg(total, F.grouping(rows[0]).alias("_gr"))
    return g.select(tab, *rows, (F.col("_gr") == 1).alias(ROW_TOTAL),
                    F.explode(F.array(F.lit(False), F.lit(True))).alias(COL_TOTAL), VALUE)


def store_cells(sparse: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``sparse`` stored, with the numbers of its row keys and column keys over
    all tabs (bounds for ``key_grid``), counted in the same pass."""
    held, n = cut_lineage(sparse, rows=F.count_if(F.col(COL_TOTAL)), cols=F.count_if(F.col(ROW_TOTAL) & ~F.col(COL_TOTAL)))
    return held, (n["rows"], n["cols"])


def densify(sparse: DataFrame, tab: str, rows: str | Sequence[str], cols: str | Sequence[str],
            block: int = BLOCK_KEYS, sizes: tuple[int, int] | None = None, row_totals: bool = False) -> DataFrame:
    """``sparse`` with a zero for each row key and column key (of any tab) that
    do not meet. ``sparse`` is read several times: hand over a stored table.
    ``row_totals``: with the row's total beside each cell, for its percentage."""
    rows, cols = as_list(rows), as_list(cols)
    keys = [tab, *rows, *cols, ROW_TOTAL, COL_TOTAL]
    extra = [f"_{ROW_PCT}"] if row_totals else []
    if not cols:
        return sparse.withColumns({c: F.col(VALUE) for c in extra})
    total = F.col(VALUE).alias(f"_{ROW_PCT}")
    left = sparse.where(F.col(COL_TOTAL)).select(tab, *rows, ROW_TOTAL, *[total for _ in extra])
    right = sparse.where(F.col(ROW_TOTAL) & ~F.col(COL_TOTAL)).select(*cols).distinct()
    kind = sparse.schema[VALUE].dataType
    zeros = key_grid(left, right, block=block, sizes=sizes).withColumn(COL_TOTAL, F.lit(False)).withColumn(VALUE, F.lit(0).cast(kind))
    own = sparse.withColumns({c: F.when(F.col(COL_TOTAL), F.col(VALUE)) for c in extra})
    both = own.unionByName(zeros.select(*own.columns))
    return both.groupBy(*keys).agg(F.max_by(VALUE, F.abs(VALUE)).alias(VALUE), *[F.max(c).alias(c) for c in extra])


def crosstab_cells(filtered: DataFrame, tab: str, rows: str | Sequence[str], cols: str | Sequence[str],
                   metric: str) -> DataFrame:
    """Crosstab of sum(metric) by tab x rows x cols with totals (long form)."""
    sparse = sparse_cells(filtered, tab, rows, cols, metric)
    if not as_list(cols):
        return sparse
    held, sizes = store_cells(sparse)
    return densify(held, tab, rows, cols, sizes=sizes)


def attach(cells: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with the other columns of ``side`` (one row per key; NULL keys
    meet NULL keys), by an equi-join."""
    named = side.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return cells.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def with_percentages(cells: DataFrame, tab: str, rows: Sequence[str], cols: Sequence[str],
                     value: str = VALUE, totals: DataFrame | None = None,
                     kinds: Sequence[str] = (ROW_PCT, "col_pct", "total_pct")) -> DataFrame:
    """row_pct = cell / its row total, col_pct = cell / its column total,
    total_pct = cell / grand total; a zero denominator gives NULL. ``totals``:
    where the totals are read from (the stored sparse cells; default: cells).
    ``kinds``: which of the three are wanted. A total that ``cells`` carry already
    is taken from there."""
    rows, cols = as_list(rows), as_list(cols)
    totals = cells if totals is None else totals
    sides = {ROW_PCT: (COL_TOTAL, [tab, *rows, ROW_TOTAL]), "col_pct": (ROW_TOTAL, [tab, *cols, COL_TOTAL]), "total_pct": (None, [tab])}
    out = cells
    for name in kinds:
        flag, keys = sides[name]
        if f"_{name}" in cells.columns:
            continue
        where = F.col(flag) if flag else F.col(ROW_TOTAL) & F.col(COL_TOTAL)
        out = attach(out, totals.where(where).select(*keys, F.col(value).alias(f"_{name}")), keys)
    return out.select(*[c for c in cells.columns if c != f"_{ROW_PCT}"], *[safe_div(value, f"_{name}").alias(name) for name in kinds])


def heat_scale(cells: DataFrame, tab: str, rows: Sequence[str], cols: Sequence[str], value: str = VALUE) -> DataFrame:
    """Colour intensity of inner cells on a 0..max scale: over the whole table
    of a tab, per column, per row. Totals get NULL; an all-zero scale gives 0."""
    rows, cols = as_list(rows), as_list(cols)
    is_inner = ~F.col(ROW_TOTAL) & ~F.col(COL_TOTAL)
    inner = cells.where(is_inner)
    v = F.col(value).cast("double")
    out = cells
    for name, keys in (("heat_table", [tab]), ("heat_col", [tab, *cols]), ("heat_row", [tab, *rows])):
        out = attach(out, inner.groupBy(*keys).agg(F.max(v).alias(f"_{name}")), keys)

    def scaled(name: str) -> Column:
        mx = F.col(f"_{name}")
        return F.when(is_inner, F.when(mx == 0, F.lit(0.0)).otherwise(F.try_divide(v, mx))).alias(name)

    return out.select(*cells.columns, scaled("heat_table"), scaled("heat_col"), scaled("heat_row"))


def mean_crosstab(df: DataFrame, rows: Sequence[str], cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Ad-hoc crosstab of means (long form): one row per (rows, cols) group
    present, one ``avg_<value>`` column per value; NULL keys are left out."""
    keys = as_list(rows) + as_list(cols)
    src = df.where(all_not_null(keys))
    return src.groupBy(*keys).agg(*[F.avg(F.col(v).cast("double")).alias(f"avg_{v}") for v in values])


def label_totals(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], label: str = TOTAL_LABEL) -> DataFrame:
    """Sink-side labels: total keys become ``label`` on the first level and ''
    on further levels; keys are cast to text."""
    out = {}
    for flag, dims in ((ROW_TOTAL, as_list(rows)), (COL_TOTAL, as_list(cols))):
        for i, d in enumerate(dims):
            out[d] = F.when(F.col(flag), F.lit(label if i == 0 else "")).otherwise(F.col(d).cast("string")).alias(d)
    return cells.select(*[out.get(c, F.col(c)) for c in cells.columns])
