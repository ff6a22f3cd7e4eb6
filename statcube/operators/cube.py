"""Cube construction and inspection.

``build_cube`` turns microdata into a statistical cube the way a delivery is
produced: grouping sets from a layout of fixed / rollup / grouping-set
dimensions, a grouping id ``GID``, and a suppression flag.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statcube.functions import safe_div
from statcube.schema import COUNT_COL, GID_COL, MASKED, NORMAL, STATUS_COL, SUPPRESS_BELOW, dimension_columns


def grouping_sets_for(fixed: Sequence[str], rollup: Sequence[str], grouping: Sequence[str]) -> list[list[str]]:
    """Grouping sets of a cube layout: fixed dims are always grouped, a rollup
    contributes each of its prefixes, grouping-set dims contribute every subset."""
    rollup_parts = [list(rollup[:i]) for i in range(len(rollup) + 1)]
    subset_parts = [list(c) for k in range(len(grouping) + 1) for c in combinations(grouping, k)]
    return [list(fixed) + r + s for r in rollup_parts for s in subset_parts]


def gid_expr(dims: Sequence[str]) -> Column:
    """Grouping id over ``dims``: bit (n-1-i) set when dims[i] is aggregated."""
    n = len(dims)
    out = F.lit(0).cast("long")
    for i, d in enumerate(dims):
        out = out + F.grouping(d).cast("long") * F.lit(1 << (n - 1 - i))
    return out


@dataclass(frozen=True)
class CubeLayout:
    """The grouping sets of a cube, and which rows aggregate over a dimension by
    their grouping id: in such a cube a NULL may also be a value that is missing
    in the microdata, so NULL alone does not tell a subtotal."""

    fixed: tuple[str, ...]
    rollup: tuple[str, ...] = ()
    grouping: tuple[str, ...] = ()
    derived: Mapping[str, str] = field(default_factory=dict)  # derived column -> parent

    @property
    def gid_dims(self) -> list[str]:
        return [*self.rollup, *self.grouping]

    def aggregated(self, dim: str) -> Column:
        """Rows that aggregate over ``dim``: their grouping ids, listed, so that
        a scan can use the predicate."""
        dim = self.derived.get(dim, dim)
        if dim in self.fixed:
            return F.lit(False)
        dims = self.gid_dims
        if dim not in dims:
            raise ValueError(f"'{dim}' is not in the cube's layout")
        sets = grouping_sets_for(self.fixed, self.rollup, self.grouping)
        gids = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s) for s in sets if dim not in s}
        return F.col(GID_COL).isin(sorted(gids))


def layout_of(group_types: Mapping[str, str]) -> dict[str, list[str]]:
    """Fixed, rollup and grouping-set dimensions, in the codebook's order."""
    kinds = {"fixed": "fixed", "rollup": "rollup", "grouping_set": "grouping"}
    odd = sorted(set(group_types.values()) - set(kinds))
    if odd:
        raise ValueError(f"unknown group types: {odd}")
    return {name: [c for c, t in group_types.items() if kinds[t] == name] for name in kinds.values()}


def build_cube(df: DataFrame, fixed: Sequence[str], rollup: Sequence[str], grouping: Sequence[str],
               metrics: Mapping[str, Column], gid_dims: Sequence[str] | None = None) -> DataFrame:
    """Cube cells of ``df``.

    ``metrics`` maps output name -> additive aggregate (sum or count). Output
    columns: dims in layout order, metrics, ``GID``. The rows are summed to leaf
    cells first (map-side combined, one shuffle of the facts), and only leaf
    cells are expanded into the grouping sets, whose metrics are sums of the
    leaves'.
    """
    dims = list(fixed) + list(rollup) + list(grouping)
    sets = grouping_sets_for(fixed, rollup, grouping)
    gdims = list(gid_dims) if gid_dims is not None else list(rollup) + list(grouping)
    leaves = df.groupBy(*dims).agg(*[e.alias(n) for n, e in metrics.items()])
    aggs = [F.sum(n).alias(n) for n in metrics] + [gid_expr(gdims).alias(GID_COL)]
    return leaves.groupingSets(sets, *dims).agg(*aggs)


def flag_suppressed(cube: DataFrame, count_col: str = COUNT_COL, below: int = SUPPRESS_BELOW) -> DataFrame:
    """DATA_STATUS = masked when the cell has fewer than ``below`` rows."""
    return cube.withColumn(STATUS_COL, F.when(F.col(count_col) < below, F.lit(MASKED)).otherwise(F.lit(NORMAL)))


def grouping_fingerprint(cube: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """Per GID, the name of each dimension that is populated in that grouping
    set (NULL when it is aggregated): one ``has_<dim>`` column per dim."""
    dims = list(dims) if dims is not None else [d for d in dimension_columns(cube)]
    return cube.groupBy(GID_COL).agg(*[
        F.when(F.max(F.col(d).cast("string")).isNotNull(), F.lit(d)).alias(f"has_{d.lower()}") for d in dims
    ])


def masked_ratio(cube: DataFrame, by: Sequence[str] = (GID_COL,)) -> DataFrame:
    """Suppressed cells per group: total cells, masked cells, masked ratio."""
    return (cube.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_cells"),
                 F.count_if(F.col(STATUS_COL) == MASKED).alias("n_masked"))
            .withColumn("masked_ratio", safe_div("n_masked", "n_cells")))


def grouping_set(cube: DataFrame, gid: int) -> DataFrame:
    """Cells of one grouping set."""
    return cube.where(F.col(GID_COL) == gid)


def split_status(cube: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published cells, suppressed cells)."""
    return cube.where(F.col(STATUS_COL) == NORMAL), cube.where(F.col(STATUS_COL) == MASKED)


def distinct_gids(cube: DataFrame) -> DataFrame:
    return cube.select(GID_COL).distinct()
