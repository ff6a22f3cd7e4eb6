"""``Crosstab``: every output of one crosstab query over a cube, each a lazy
DataFrame keyed by the tab column (no per-tab loop)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statcube.operators import averages as avg_ops
from statcube.operators import crosstab as xt
from statcube.operators import drill, filters, growth, layout, ordering
from statcube.operators.cube import CubeLayout
from statcube.operators.probe_index import ProbeIndex, probe_conditions
from statcube.operators.reference import reference_totals
from statcube.plans.spec import CrosstabSpec
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook

class Crosstab:
    def __init__(self, cube: DataFrame, spec: CrosstabSpec, codebook: Codebook | None = None,
                 mode: str = "eager", flags: list[bool] | None = None, layout: CubeLayout | None = None,
                 index: ProbeIndex | None = None):
        """``flags``: probe outcomes already known for this spec. ``layout``:
        subtotals are told by the cube's grouping id instead of NULL. ``index``:
        the cube's stored index, from which the probes are answered."""
        spec.validate()
        spec.check_columns(cube.columns)
        self.cube, self.spec, self.mode = cube, spec, mode
        self.codebook = codebook or Codebook()
        if flags is None and index is not None:
            flags = index.flags([probe_conditions(cube, spec.tab, spec.rows, spec.cols, spec.filters, spec.probe)])[0]
        self.flags = flags
        self.marker = layout.aggregated if layout else filters.is_null

    # -- filtering ------------------------------------------------------------
    @cached_property
    def filtered(self) -> DataFrame:
        s = self.spec
        return filters.smart_filter(self.cube, s.tab, list(s.rows), list(s.cols), s.filters, s.probe, self.mode,
                                    flags=self.flags, marker=self.marker)

    def masked(self) -> DataFrame:
        return filters.masked_rows(self.filtered)

    def masked_detail(self) -> DataFrame:
        return drill.masked_detail(self.masked(), self.codebook)

    # -- crosstab -------------------------------------------------------------
    @cached_property
    def _stored(self) -> tuple[DataFrame, tuple[int, int]]:
        s = self.spec
        return xt.store_cells(xt.sparse_cells(self.filtered, s.tab, list(s.rows), list(s.cols), s.metric))

    @property
    def _sparse(self) -> DataFrame:
        """Cells that are present and all totals, stored: the cube is read once
        for every output below."""
        return self._stored[0]

    def _dense(self, row_totals: bool = False) -> DataFrame:
        s = self.spec
        return xt.densify(self._sparse, s.tab, list(s.rows), list(s.cols), sizes=self._stored[1], row_totals=row_totals)

    def _column_totals(self) -> DataFrame:
        """The total row of each tab, with a zero for columns seen in other tabs only."""
        s = self.spec
        return xt.densify(self._sparse.where(F.col(xt.ROW_TOTAL)).drop(*s.rows), s.tab, [], list(s.cols), sizes=self._stored[1])

    def cells(self, percentages: bool = True) -> DataFrame:
        s = self.spec
        return xt.with_percentages(self._dense(True), s.tab, s.rows, s.cols, totals=self._sparse) if percentages else self._dense()

    def heat(self) -> DataFrame:
        s = self.spec
        return xt.heat_scale(cut_lineage(self._dense()), s.tab, s.rows, s.cols)

    def averages(self) -> DataFrame:
        s = self.spec
        return avg_ops.weighted_averages(self.filtered, s.tab, list(s.rows), list(s.cols), self.codebook)

    def reference_totals(self) -> DataFrame:
        s = self.spec
        return reference_totals(self.cube, s.tab, list(s.rows), list(s.cols), s.filters, self.codebook.derived, marker=self.marker)

    def reference_rows(self, tab_value=None) -> DataFrame:
        """The published rows behind the reference totals (of one tab)."""
        s = self.spec
        rows = filters.reference_rows(self.cube, s.tab, list(s.rows), list(s.cols), s.filters, self.codebook.derived, self.marker)
        return rows if tab_value is None else filters.rows_of_tab(rows, s.tab, tab_value)

    def drill_summary(self) -> DataFrame:
        return drill.drill_summary(self.filtered, self.spec.tab)

    # -- growth ---------------------------------------------------------------
    def growth(self, by: str = "all") -> DataFrame:
        s = self.spec
        if by == "all":
            return growth.overall_growth(self._sparse, s.tab)
        if by == "rows":
            return growth.row_growth(self._sparse, s.tab, list(s.rows))
        if by == "cols":
            return growth.col_growth(self._sparse, s.tab, list(s.cols))
        raise ValueError("by must be 'all', 'rows' or 'cols'")

    # -- ordering & layout ------------------------------------------------------
    def tab_order(self) -> DataFrame:
        return ordering.tab_order(self.filtered, self.spec.tab, self.codebook)

    def row_order(self) -> DataFrame:
        s = self.spec
        return ordering.axis_order(self._sparse.where(F.col(xt.COL_TOTAL)), s.tab, list(s.rows), xt.ROW_TOTAL,
                                   self.codebook, "row_rank")

    def col_order(self) -> DataFrame:
        s = self.spec
        if not s.cols:
            raise ValueError("no column dimensions")
        return ordering.axis_order(self._column_totals(), s.tab, list(s.cols), xt.COL_TOTAL,
                                   self.codebook, "col_rank")

    def mix(self) -> DataFrame:
        """MIX layout cells. The total column and the column order come from the
        stored sparse cells; the cells with their zeros are read once."""
        s = self.spec
        names = [a.name for a in avg_ops.avg_specs(self.codebook, s.cols)]
        cells = xt.with_percentages(self._dense(True), s.tab, s.rows, s.cols, totals=self._sparse, kinds=[xt.ROW_PCT])
        return layout.mix_cells(cells, self.averages(), s.tab, list(s.rows), list(s.cols), self.codebook, names, s.metric,
                                totals=self._sparse)
