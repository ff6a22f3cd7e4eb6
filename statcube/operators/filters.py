"""Filters over a cube.

The central one is ``smart_filter`` (aggregate-aware filter): for every
dimension that is neither filtered into an axis nor an axis itself, use the
cube's own subtotal rows (dimension IS NULL) when they exist under the
predicates of the dimensions before it, otherwise sum the leaf rows. This keeps
a crosstab over a GROUPING SETS cube from counting subtotals twice.

All probes depend only on their own prefix predicate, so they are computed in
ONE aggregate pass over the cube:

* ``mode="eager"``: the pass returns one row of booleans to the driver and the
  final filter is a conjunction of literal ``IS NULL`` / ``IN`` predicates that
  Parquet pushes down into the scan.
* ``mode="lazy"``: the booleans stay scalar subqueries inside one plan (Spark
  merges them into a single aggregate); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statcube.functions import conj, equals_value, isin_coerced
from statcube.schema import MASKED, STATUS_COL, dimension_columns


# Which rows aggregate over a dimension. A delivered cube marks them by NULL; one
# whose layout is known by GID (``CubeLayout.aggregated``).
Marker = Callable[[str], Column]


def is_null(dim: str) -> Column:
    return F.col(dim).isNull()


def as_list(x: str | Sequence[str] | None) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def validate_axes(tab: str | None, rows: Sequence[str], cols: Sequence[str]) -> None:
    """Row and column dimensions must not overlap; the tab is not an axis."""
    overlap = set(rows) & set(cols)
    if overlap:
        raise ValueError(f"row and column dimensions overlap: {sorted(overlap)}")
    if tab is not None and (tab in rows or tab in cols):
        raise ValueError(f"tab '{tab}' is also used as an axis")


def in_filter_predicate(df: DataFrame, filters: Mapping[str, Sequence]) -> Column:
    """AND of IN predicates on dimension columns (values coerced to the column
    type); filters on metrics or unknown columns are ignored."""
    dims = set(dimension_columns(df))
    return conj(isin_coerced(c, df.schema[c].dataType, v) for c, v in filters.items() if c in dims)


def in_filter(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    return df.where(in_filter_predicate(df, filters))


def probe_plan(df: DataFrame, tab: str | None, rows: Sequence[str], cols: Sequence[str],
               filters: Mapping[str, Sequence], probe: str = "prefix",
               marker: Marker = is_null) -> tuple[Column, list[tuple[str, Column]]]:
    """(final base predicate, [(probed dim, predicate its probe runs under)])."""
    axes = set(as_list(tab)) | set(rows) | set(cols)
    base = F.lit(True)
    probes: list[tuple[str, Column]] = []
    for d in dimension_columns(df):
        if d in filters:
            base = base & isin_coerced(d, df.schema[d].dataType, filters[d])
        if d in axes:
            base = base & ~marker(d)
        else:
            probes.append((d, base))
    if probe == "full":
        probes = [(d, base) for d, _ in probes]
    elif probe != "prefix":
        raise ValueError("probe must be 'prefix' or 'full'")
    return base, probes


def subtotal_flags(df: DataFrame, probes: list[tuple[str, Column]], marker: Marker = is_null) -> list[bool]:
    """One aggregate pass: does a subtotal row exist for each probed dim?"""
    if not probes:
        return []
    # every probe predicate implies the first one: let it prune the scan
    scan = df.where(probes[0][1])
    row = scan.agg(*[F.coalesce(F.bool_or(p & marker(d)), F.lit(False)).alias(f"h{i}")
                     for i, (d, p) in enumerate(probes)]).first()
    return [bool(row[i]) for i in range(len(probes))]


def subtotal_flags_many(df: DataFrame, plans: list[list[tuple[str, Column]]]) -> list[list[bool]]:
    """The probes of several crosstabs over one cube in a single aggregate pass."""
    exprs = [F.coalesce(F.bool_or(p & F.col(d).isNull()), F.lit(False)).alias(f"h{i}_{j}")
             for i, probes in enumerate(plans) for j, (d, p) in enumerate(probes)]
    if not exprs:
        return [[] for _ in plans]
    row = df.agg(*exprs).first()
    return [[bool(row[f"h{i}_{j}"]) for j in range(len(probes))] for i, probes in enumerate(plans)]


def filter_predicate(base: Column, probes: list[tuple[str, Column]], flags: list[bool], marker: Marker = is_null) -> Column:
    """Final predicate once the probe outcomes are known."""
    return base & conj(marker(d) for (d, _), h in zip(probes, flags) if h)


def smart_filter(df: DataFrame, tab: str | None, rows: str | Sequence[str], cols: str | Sequence[str] = (),
                 filters: Mapping[str, Sequence] | None = None, probe: str = "prefix", mode: str = "eager",
                 tab_value=None, flags: list[bool] | None = None, marker: Marker = is_null) -> DataFrame:
    """Rows of the cube a crosstab over (tab, rows, cols) must sum.
    ``flags``: probe outcomes already computed (e.g. for a batch of specs)."""
    rows, cols, filters = as_list(rows), as_list(cols), dict(filters or {})
    base, probes = probe_plan(df, tab, rows, cols, filters, probe, marker)
    if flags is not None:
        pred = filter_predicate(base, probes, flags, marker)
    elif mode == "eager":
        pred = filter_predicate(base, probes, subtotal_flags(df, probes, marker), marker)
    elif mode == "lazy":
        preds = []
        for d, p in probes:
            has = df.select(F.coalesce(F.bool_or(p & marker(d)), F.lit(False))).scalar()
            preds.append(~has | marker(d))
        pred = base & conj(preds)
    else:
        raise ValueError("mode must be 'eager' or 'lazy'")
    if tab_value is not None and tab is not None:
        pred = pred & equals_value(tab, df.schema[tab].dataType, tab_value)
    return df.where(pred)


def reference_rows(df: DataFrame, tab: str, rows: Sequence[str], cols: Sequence[str],
                   filters: Mapping[str, Sequence] | None = None,
                   derived: Mapping[str, str] | None = None, marker: Marker = is_null) -> DataFrame:
    """Published parent rows behind a crosstab."""
    return df.where(reference_predicate(df, tab, rows, cols, filters, derived, marker))


def reference_predicate(df: DataFrame, tab: str, rows: Sequence[str], cols: Sequence[str],
                        filters: Mapping[str, Sequence] | None = None,
                        derived: Mapping[str, str] | None = None, marker: Marker = is_null) -> Column:
    """Which rows are published parents of a crosstab: filters on non-axis dims apply,
    axes and every unfiltered dim are forced to the subtotal (NULL), the tab is
    non-null. A derived dim (REGION) whose parent (COUNTY) is filtered is left
    free, since parent rows carrying a county filter have no region."""
    filters, derived = dict(filters or {}), dict(derived or {})
    dims = dimension_columns(df)
    axes = set(rows) | set(cols)
    preds = [~marker(tab)]
    for c, vals in filters.items():
        if c in dims and c not in axes and c != tab:
            preds.append(isin_coerced(c, df.schema[c].dataType, vals))
    for c in axes:
        preds.append(marker(c))
    for d in dims:
        if d in filters or d in axes or d == tab:
            continue
        parent = derived.get(d)
        if parent is not None and parent in filters and parent not in axes:
            continue
        preds.append(marker(d))
    return conj(preds)


def masked_rows(df: DataFrame) -> DataFrame:
    """Suppressed cells; an empty frame of the same schema when the cube has no
    status column."""
    if STATUS_COL not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col(STATUS_COL) == MASKED)


def rows_of_tab(df: DataFrame, tab: str, value) -> DataFrame:
    """Rows of one tab; a value kept as text finds its number ('2021' finds
    2021). The tab is compared in its own type, so scans can use it."""
    return df.where(equals_value(tab, df.schema[tab].dataType, value))


def exclude_labels(df: DataFrame, axes: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Drop rows whose label on any axis is one of ``labels``."""
    if not labels:
        return df
    return df.where(conj(~F.col(a).cast("string").isin(list(labels)) for a in axes))
