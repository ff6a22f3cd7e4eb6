"""Report sheets of many specs over one cube from one aggregate.

Every cube row becomes one row (spec, tab, row keys, column keys) for each spec
whose filter it passes, and one grouping-sets aggregate of these rows holds the
present cells and all totals of all specs. It is stored, and everything else
reads it: the focus tab of each spec, the column order, and the cells of that
tab, to which zeros are added last. The number of jobs does not depend on the
number of specs. Keys are text, as a report shows them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import equals_value, format_class, numeric_text, ratio_inf, ratio_or_zero, safe_div
from statcube.operators import averages, filters
from statcube.operators.crosstab import COL_TOTAL, ROW_TOTAL, VALUE, key_grid
from statcube.operators.layout import PCT_SUFFIX
from statcube.operators.ordering import ranked
from statcube.operators.probe_index import ProbeIndex, probe_conditions
from statcube.plans.spec import CrosstabSpec
from statcube.schema import COUNT_COL, MASKED, STATUS_COL, TOTAL_LABEL, YEAR_TAB
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook

ID = "sheet_rank"
ROWS, COLS = ["row_1", "row_2"], ["col_1", "col_2"]


@dataclass(frozen=True)
class SheetSpec:
    """A crosstab spec with its sheet's number and the tab it is to show."""

    id: int
    spec: CrosstabSpec
    wanted_tab: str | None = None


class SharedSheets:
    def __init__(self, cube: DataFrame, codebook: Codebook, sheets: Sequence[SheetSpec],
                 index: ProbeIndex | None = None):
        """``index``: the cube's stored index; without one, one pass over the
        cube answers the probes of all sheets."""
        self.cube, self.codebook, self.sheets = cube, codebook, list(sheets)
        plans = [filters.probe_plan(cube, s.spec.tab, list(s.spec.rows), list(s.spec.cols), s.spec.filters, s.spec.probe)
                 for s in self.sheets]
        if index is not None:
            flags = index.flags([probe_conditions(cube, s.spec.tab, s.spec.rows, s.spec.cols, s.spec.filters, s.spec.probe) for s in self.sheets])
        else:
            flags = filters.subtotal_flags_many(cube, [p[1] for p in plans])
        self.predicates = [filters.filter_predicate(base, probes, f) for (base, probes), f in zip(plans, flags)]

    # -- what the specs say -----------------------------------------------------
    @cached_property
    def _averages(self) -> dict[averages.AvgSpec, dict[int, int]]:
        """Each weighted average with its position in the sheets that show it."""
        out: dict = {}
        for s in self.sheets:
            found = averages.avg_specs(self.codebook, s.spec.cols)
            if all(c in self.cube.columns for a in found for c in (a.num, a.den)):
                for i, a in enumerate(found):
                    out.setdefault((a.name, a.num, a.den), {})[s.id] = i + 1
        return {averages.AvgSpec(*k): v for k, v in out.items()}

    @cached_property
    def _conf(self) -> DataFrame:
        """One row a sheet: its dimensions and how they are shown."""
        def numeric(c: str) -> bool:
            return isinstance(self.cube.schema[c].dataType, T.NumericType)

        rows = []
        for s in self.sheets:
            x = s.spec
            kind = "codes" if self.codebook.has_codes(x.tab) else "year" if x.tab == YEAR_TAB else "number" if numeric(x.tab) else "text"
            cols = [*x.cols, None, None][:2]
            n_avg = sum(s.id in at for at in self._averages.values())
            rows.append((s.id, x.tab, kind, *cols, *[bool(c and numeric(c)) for c in cols], len(x.rows), x.metric, n_avg))
        return self.cube.sparkSession.createDataFrame(
            rows, f"{ID} long, tab_dim string, tab_kind string, dim_1 string, dim_2 string, num_1 boolean, num_2 boolean, "
                  "n_rows int, metric string, n_avg int")

    @cached_property
    def _ranks(self) -> DataFrame:
        """(dim, label, rank) of the dimensions with code lists."""
        dims = sorted({d for s in self.sheets for d in (s.spec.tab, *s.spec.cols) if self.codebook.has_codes(d)})
        spark = self.cube.sparkSession
        parts = [self.codebook.label_ranks(spark, d).select(F.lit(d).alias("dim"), "label", F.col("rank").cast("double")) for d in dims]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "dim string, label string, rank double")

    # -- the aggregate ------------------------------------------------------------
    @cached_property
    def sparse(self) -> DataFrame:
        """Present cells and all totals of all specs and tabs, stored."""
        schema = self.cube.schema
        whole = all(isinstance(schema[s.spec.metric].dataType, T.IntegralType) for s in self.sheets)
        kind = "long" if whole else "double"
        sums = list(dict.fromkeys(c for a in self._averages for c in (a.num, a.den)))

        def text(dims: Sequence[str], i: int) -> Column:
            return F.col(dims[i]).cast("string") if i < len(dims) else F.lit(None).cast("string")

        def row(s: SheetSpec) -> Column:
            x = s.spec
            wanted = equals_value(x.tab, schema[x.tab].dataType, s.wanted_tab) if s.wanted_tab else F.lit(False)
            return F.struct(
                F.lit(s.id).cast("long").alias(ID), F.col(x.tab).cast("string").alias("tab"), wanted.alias("wanted"),
                *[text(x.rows, i).alias(c) for i, c in enumerate(ROWS)], *[text(x.cols, i).alias(c) for i, c in enumerate(COLS)],
                F.col(x.metric).cast(kind).alias("_v"))

        own = F.array(*[F.when(p, row(s)) for p, s in zip(self.predicates, self.sheets)])
        kept = self.cube.where(reduce(lambda a, b: a | b, self.predicates))
        src = kept.select(F.inline(F.filter(own, lambda x: x.isNotNull())), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(sums)])
        head = [ID, "tab"]
        sets = [[*head, *ROWS, *COLS], [*head, *ROWS], [*head, *COLS], head]
        g = src.groupingSets(sets, *head, *ROWS, *COLS).agg(
            F.coalesce(F.sum("_v"), F.lit(0).cast(kind)).alias(VALUE), F.max("wanted").alias("wanted"),
            *[F.coalesce(F.sum(f"_s{i}"), F.lit(0)).alias(c) for i, c in enumerate(f"sum_{c}" for c in sums)],
            (F.grouping(ROWS[0]) == 1).alias(ROW_TOTAL), (F.grouping(COLS[0]) == 1).alias(COL_TOTAL))
        return cut_lineage(g)

    @cached_property
    def focus(self) -> DataFrame:
        """(sheet, tab): the wanted tab where it has data, else the first in tab
        order; a sheet without data has no row."""
        tabs = (self.sparse.where(F.col(ROW_TOTAL) & F.col(COL_TOTAL)).select(ID, "tab", "wanted").join(self._conf, ID)
                .join(self._ranks, (F.col("tab_dim") == F.col("dim")) & (F.col("tab") == F.col("label")), "left"))
        number = F.col("tab").try_cast("double")
        key = (F.when(F.col("tab_kind") == "codes", F.coalesce("rank", F.lit(float("inf"))))
               .when(F.col("tab_kind") == "year", -number).when(F.col("tab_kind") == "number", number))
        other = F.struct(~F.col("wanted"), F.coalesce(key, F.lit(0.0)), F.col("tab"))
        as_number = F.struct(~F.col("wanted"), F.coalesce(number, F.lit(0.0)), F.col("tab"))
        numbers = F.bool_and((F.col("tab_kind") == "text") & (numeric_text("tab").cast("int") == 1))
        picked = tabs.groupBy(ID).agg(F.when(numbers, F.min_by("tab", as_number)).otherwise(F.min_by("tab", other)).alias("tab"))
        return cut_lineage(picked)

    # -- the sheets -----------------------------------------------------------------
    def _columns(self) -> DataFrame:
        """The column keys of each sheet (seen in any tab) with their place."""
        keys = self.sparse.where(F.col(ROW_TOTAL) & ~F.col(COL_TOTAL)).select(ID, *COLS).distinct().join(self._conf.select(ID, "dim_1", "dim_2", "num_1", "num_2"), ID)
        order: list[Column] = []
        for i, c in enumerate(COLS, 1):
            r = self._ranks.select(F.col("dim").alias(f"dim_{i}"), F.col("label").alias(c), F.col("rank").alias(f"rank_{i}"))
            keys = keys.join(r, [f"dim_{i}", c], "left")
            order.append(F.col(f"rank_{i}").asc_nulls_last())
        for i, c in enumerate(COLS, 1):
            order += [F.when(F.col(f"num_{i}"), F.col(c).try_cast("double")).asc_nulls_first(), F.col(c).asc_nulls_first()]
        return ranked(keys, [ID], order, "place").select(ID, *COLS, "place")

    def cells(self) -> DataFrame:
        """MIX cells of the focus tab of each sheet: the total column, the
        averages, then value and row percent of each column key."""
        here = self.sparse.join(self.focus, [ID, "tab"])
        head = [ID, "tab", *ROWS, ROW_TOTAL]
        lines = here.where(F.col(COL_TOTAL))
        shown = [F.struct(F.lit(TOTAL_LABEL).alias("column"), F.lit("value").alias("kind"), F.col(VALUE).cast("double").alias("value"),
                          F.lit(0).cast("long").alias("col_order"))]
        for a, at in self._averages.items():
            num, den = f"sum_{a.num}", f"sum_{a.den}"
            value = F.when(F.col(ROW_TOTAL), ratio_or_zero(num, den)).otherwise(ratio_inf(num, den, zero_over_zero=F.lit(0.0)))
            place = F.try_element_at(F.create_map(*[F.lit(x) for kv in at.items() for x in kv]), F.col(ID).cast("int"))
            shown.append(F.when(place.isNotNull(), F.struct(F.lit(a.name).alias("column"), F.lit("avg").alias("kind"), value.cast("double").alias("value"),
                                                            place.cast("long").alias("col_order"))))
        first = lines.select(*head, F.inline(F.filter(F.array(*shown), lambda x: x.isNotNull())))
        zero = F.lit(0).cast(self.sparse.schema[VALUE].dataType)
        grid = key_grid(lines.select(*head, F.col(VALUE).alias("line_total")), self._columns(), on=[ID])
        present = here.where(~F.col(COL_TOTAL)).select(*head, *COLS, F.col(VALUE), F.lit(None).cast(grid.schema["line_total"].dataType).alias("line_total"),
                                                       F.lit(None).cast("long").alias("place"))
        dense = (grid.withColumn(VALUE, zero).select(*present.columns).unionByName(present).groupBy(*head, *COLS)
                 .agg(F.max("place").alias("place"), F.max("line_total").alias("line_total"), F.sum(VALUE).alias(VALUE))
                 .join(self._conf.select(ID, "dim_1", "dim_2", "metric", "n_avg"), ID))
        label = (F.when(F.col("dim_1").isNull(), F.col("metric")).when(F.col("dim_2").isNull(), F.col("col_1"))
                 .otherwise(F.concat(F.lit("('"), F.concat_ws("', '", *COLS), F.lit("')"))))
        place = (F.col("n_avg") + 2 * F.col("place") - 1).cast("long")
        pair = F.array(F.struct(label.alias("column"), F.lit("value").alias("kind"), F.col(VALUE).cast("double").alias("value"), place.alias("col_order")),
                       F.struct(F.concat(label, F.lit(PCT_SUFFIX)).alias("column"), F.lit("pct").alias("kind"),
                                safe_div(VALUE, "line_total").alias("value"), (place + 1).alias("col_order")))
        out = first.unionByName(dense.select(*head, F.inline(pair))).join(self._conf.select(ID, "n_rows"), ID)
        named = [F.when(F.col(ROW_TOTAL), F.lit(TOTAL_LABEL)).otherwise(F.col("row_1")).alias("row_1"),
                 F.when(F.col(ROW_TOTAL) & (F.col("n_rows") > 1), F.lit("")).otherwise(F.col("row_2")).alias("row_2")]
        return out.select(ID, "tab", *named, ROW_TOTAL, "column", "kind", "value", "col_order", format_class(F.col("column")).alias("format"))

    def counts(self) -> DataFrame:
        """(sheet, tab, n_masked, ref_total) of the focus tab of each sheet, from
        one pass over the cube."""
        def row(s: SheetSpec, masked: Column, ref: Column) -> Column:
            return F.struct(F.lit(s.id).cast("long").alias(ID), F.col(s.spec.tab).cast("string").alias("tab"),
                            masked.cast("long").alias("m"), ref.cast("long").alias("r"))

        one, none = F.lit(1), F.lit(0)
        rows = []
        for p, s in zip(self.predicates, self.sheets):
            x = s.spec
            if STATUS_COL in self.cube.columns:
                rows.append(F.when(p & (F.col(STATUS_COL) == MASKED), row(s, one, none)))
            ref = filters.reference_predicate(self.cube, x.tab, list(x.rows), list(x.cols), x.filters, self.codebook.derived)
            rows.append(F.when(ref, row(s, none, F.col(COUNT_COL))))
        found = (self.cube.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).groupBy(ID, "tab")
                 .agg(F.sum("m").alias("m"), F.sum("r").alias("r")))
        return self.focus.join(found, [ID, "tab"], "left").select(
            ID, "tab", F.coalesce("m", F.lit(0)).cast("long").alias("n_masked"), F.coalesce("r", F.lit(0)).cast("long").alias("ref_total"))
