"""Preset report tables: sum of one value by rows × cols over a source, with
labels excluded from both axes, subtotal-aware like every crosstab."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statcube.operators.crosstab import densify, sparse_cells, store_cells, with_percentages
from statcube.operators.filters import exclude_labels, smart_filter, validate_axes
from statcube.sources.codebook import Codebook, load_codebook

ALL = "__all"


def load_presets(path: str) -> list[dict]:
    """Preset tasks from a YAML file (configuration)."""
    cfg = load_codebook(path)
    tasks = []
    for group in cfg.get("presets", []) if isinstance(cfg.get("presets"), list) else []:
        tasks.extend(group.get("tasks", [group]) if isinstance(group, dict) else [])
    return tasks


def resolve_columns(names, columns, codebook: Codebook) -> list[str]:
    """Column keys for axis names given as keys or display names."""
    by_display = {codebook.display_name(c): c for c in columns}
    out = []
    for n in names:
        if n in columns:
            out.append(n)
        elif n in by_display:
            out.append(by_display[n])
        else:
            raise ValueError(f"unknown column '{n}'")
    return out


def preset_crosstab(cube: DataFrame, codebook: Codebook, task: Mapping) -> DataFrame:
    """Cells (rows × cols with totals and percentages) of one preset task."""
    if str(task.get("aggfunc", "sum")).lower() != "sum":
        raise ValueError("preset tables are sums")
    rows = resolve_columns(task["rows"], cube.columns, codebook)
    cols = resolve_columns(task.get("cols") or [], cube.columns, codebook)
    validate_axes(None, rows, cols)
    value = resolve_columns([task["values"]], cube.columns, codebook)[0]
    filtered = smart_filter(cube, None, rows, cols, {})
    filtered = exclude_labels(filtered, rows + cols, task.get("exclude_values") or [])
    # one table, no tabs: a constant tab key keeps the crosstab operator whole
    src = filtered.withColumn(ALL, F.lit(1))
    sparse, sizes = store_cells(sparse_cells(src, ALL, rows, cols, value))
    return with_percentages(densify(sparse, ALL, rows, cols, sizes=sizes, row_totals=True), ALL, rows, cols, totals=sparse).drop(ALL)


def preset_batch(tasks: Sequence[Mapping], sources: Mapping[str, Callable[[], tuple[DataFrame, Codebook]]]) -> DataFrame:
    """Every preset task over the source it declares (``csv_source``), as one
    long table: name, row and column key as text (levels joined by ' / ', NULL
    for totals), flags, value and percentages. A source is built once."""
    built: dict[str, tuple[DataFrame, Codebook]] = {}
    parts = []
    for task in tasks:
        source = task["csv_source"]
        if source not in built:
            built[source] = sources[source]()
        cube, codebook = built[source]
        cells = preset_crosstab(cube, codebook, task)
        rows = resolve_columns(task["rows"], cube.columns, codebook)
        cols = resolve_columns(task.get("cols") or [], cube.columns, codebook)

        def key(dims, total):
            return F.when(~F.col(total), F.concat_ws(" / ", *[F.col(d).cast("string") for d in dims]))

        parts.append(cells.select(F.lit(task["name"]).alias("name"), key(rows, "is_row_total").alias("row_key"), key(cols, "is_col_total").alias("col_key"),
                                  "is_row_total", "is_col_total", F.col("value").cast("double").alias("value"), "row_pct", "col_pct", "total_pct"))
    if not parts:
        raise ValueError("no preset tasks")
    return reduce(DataFrame.unionByName, parts)
