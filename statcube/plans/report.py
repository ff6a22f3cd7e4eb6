"""Batch report: re-run every saved report spec and assemble one long table
of report cells (one sheet per spec), a table of contents, per-sheet notes
and an error log.

The spec list is configuration (a handful of rows): it is read as a
DataFrame, cleaned and ordered there, then brought to the driver to plan the
sheets. Each data source is built once per batch and materialised in the shared
checkpoint folder, and all its sheets come from one aggregate (``shared``).
Cells and notes are planned apart: neither works out the other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import MASKED_NOTE_TEMPLATE, fmt_count, sheet_name, strip_masked_note, typed_value
from statcube.operators import ordering
from statcube.operators.crosstab import ROW_TOTAL
from statcube.operators.ordering import chapter_sort_columns
from statcube.operators.probe_index import ProbeIndex
from statcube.plans.shared import SharedSheets, SheetSpec
from statcube.plans.spec import CrosstabSpec
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook
from statcube.sources.specs import clean_specs, parse_filters

# A cube with its codebook, and its probe index where one is stored beside it.
SourceLoader = Callable[[], tuple]

CELL_SCHEMA = T.StructType([
    T.StructField("sheet", T.StringType()), T.StructField("sheet_rank", T.LongType()),
    T.StructField("tab", T.StringType()), T.StructField("row_1", T.StringType()),
    T.StructField("row_2", T.StringType()), T.StructField(ROW_TOTAL, T.BooleanType()),
    T.StructField("column", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("col_order", T.LongType()),
    T.StructField("format", T.StringType()),
])
NOTE_SCHEMA = T.StructType([
    T.StructField("sheet", T.StringType()), T.StructField("sheet_rank", T.LongType()),
    T.StructField("chapter", T.StringType()), T.StructField("title", T.StringType()), T.StructField("headline", T.StringType()),
    T.StructField("focus_tab", T.StringType()), T.StructField("n_masked", T.LongType()),
    T.StructField("ref_total", T.LongType()), T.StructField("description", T.StringType()),
    T.StructField("auto_title", T.StringType()),
])
ERROR_SCHEMA = "Chapter string, Name string, Error string"


def ordered_specs(specs: DataFrame) -> DataFrame:
    """Cleaned specs in natural chapter order with sheet name, title and the
    parsed filter map. Ties keep the stored order."""
    s = clean_specs(specs).withColumn("position", F.monotonically_increasing_id())
    s = ordering.ranked(s, [], [*chapter_sort_columns("chapter"), F.col("position")], "sheet_rank")
    unit = F.when(F.col("unit") != "", F.concat(F.lit("("), F.col("unit"), F.lit(")"))).otherwise(F.lit(""))
    headline = F.when(F.trim(F.col("unit")) != "", F.concat(F.col("name"), F.lit(f" ({UNIT_WORD}: "), F.trim(F.col("unit")), F.lit(")"))).otherwise(F.col("name"))
    return s.select("*", headline.alias("headline"), sheet_name("chapter", F.col("sheet_rank") - 1).alias("sheet"),
                    F.concat(F.col("name"), F.lit(" "), unit).alias("title"),
                    F.trim(F.col("chapter")).alias("toc_chapter"),
                    parse_filters("filters").alias("filter_map"))


# Title words of a quickly saved report, and the word before a
# sheet's unit.
UNIT_WORD = "單位"
TITLE_CONTEXT = "住宅"
TITLE_CONTEXTS = [("單獨持有", "所有權單獨持有"), ("多人持有", "所有權多人持有")]
TITLE_NO_DIM = "總計"
OWNERSHIP_FILTER = "OWNED_TYPE"


def auto_title(focus_tab, filter_map, pivot_row, pivot_col, display_names: Mapping[str, str]):
    """'<tab> 年<context><row>分佈 - 按<row>與<col>區分': the context comes from
    the ownership filter, dimension names from the codebook ('總計' if none)."""
    owned = F.coalesce(F.try_element_at(filter_map, F.lit(OWNERSHIP_FILTER)), F.array().cast("array<string>"))
    context = F.lit(TITLE_CONTEXT)
    for value, prefix in reversed(TITLE_CONTEXTS):
        context = F.when(F.array_contains(owned, value), F.lit(prefix + TITLE_CONTEXT)).otherwise(context)
    names = F.create_map(*[x for k, v in display_names.items() for x in (F.lit(k), F.lit(v))]) \
        if display_names else None

    def dim_name(arr):
        first = F.try_element_at(arr, F.lit(1))
        named = F.coalesce(F.try_element_at(names, first), first) if names is not None else first
        return F.coalesce(named, F.lit(TITLE_NO_DIM))

    row, col = dim_name(pivot_row), dim_name(pivot_col)
    return F.concat(focus_tab.cast("string"), F.lit(" 年"), context, row, F.lit("分佈 - 按"), row, F.lit("與"), col,
                    F.lit("區分"))


def masked_note(description, n_masked, ref_total):
    """Description with the masked-cell note: an older note is removed and the
    current one appended (only when the sheet has masked cells)."""
    msg = F.concat(F.lit(MASKED_NOTE_TEMPLATE.split("{n}")[0]), n_masked.cast("string"),
                   F.lit(MASKED_NOTE_TEMPLATE.split("{n}")[1].split("{ref}")[0]), fmt_count(ref_total),
                   F.lit(MASKED_NOTE_TEMPLATE.split("{ref}")[1]))
    stripped = strip_masked_note(description)
    return F.when(n_masked > 0, F.when(stripped != "", F.concat(stripped, F.lit("\n"), msg)).otherwise(msg)) \
        .otherwise(description)


def error_text(e: Exception) -> str:
    """Kind and whole message of an error."""
    message = e.getMessage() if isinstance(e, PySparkException) else None
    return f"{type(e).__name__}: {message or e}"


class ReportBatch:
    def __init__(self, specs: DataFrame, sources: Mapping[str, SourceLoader], materialize: bool = True):
        self.spark: SparkSession = specs.sparkSession
        self.specs, self.sources, self.materialize = specs, sources, materialize
        self._cubes: dict[str, tuple[DataFrame, Codebook, ProbeIndex | None]] = {}

    @cached_property
    def ordered(self) -> DataFrame:
        return ordered_specs(self.specs)

    def toc(self) -> DataFrame:
        return self.ordered.select(F.col("toc_chapter").alias("chapter"), "title",
                                   F.concat(F.lit("internal:'"), F.col("sheet"), F.lit("'!A1")).alias("link"),
                                   "sheet", "sheet_rank")

    def _source(self, name: str) -> tuple[DataFrame, Codebook, ProbeIndex | None]:
        if name not in self._cubes:
            if name not in self.sources:
                raise FileNotFoundError(f"Data file not found: {name}")
            cube, cb, *index = self.sources[name]()
            # an index goes with a cube that is stored already
            self._cubes[name] = (cut_lineage(cube) if self.materialize and not index else cube, cb, index[0] if index else None)
        return self._cubes[name]

    @staticmethod
    def _spec_of(r) -> CrosstabSpec:
        return CrosstabSpec.of(r["pivot_tab"], list(r["pivot_row"] or []), list(r["pivot_col"] or []),
                               r["pivot_sum"] or "CNT", dict(r["filter_map"] or {}))

    @staticmethod
    def _check_filters(cube: DataFrame, spec: CrosstabSpec) -> None:
        """Filter values that a date or time column cannot hold fail their spec."""
        for c, values in spec.filters.items():
            if c in cube.columns and isinstance(cube.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                odd = [v for v in values if typed_value(cube.schema[c].dataType, v) is None]
                if odd:
                    raise ValueError(f"{c} has no values like {odd}")

    @cached_property
    def _planned(self) -> tuple[list[SharedSheets], list[tuple]]:
        """The sheets that can be worked out, by source, and (sheet number,
        chapter, name, error) of the specs that cannot."""
        errors: list[tuple] = []
        by_source: dict[str, list[tuple]] = {}
        used: set[str] = set()
        for r in self.ordered.orderBy("sheet_rank").toLocalIterator():  # one row a sheet
            try:
                if r["sheet"].lower() in used:
                    raise ValueError(f"sheet {r['sheet']!r} is already taken")
                used.add(r["sheet"].lower())
                spec = self._spec_of(r)
                cube, _, _ = self._source(r["data_source"])  # each source built once
                spec.check_columns(cube.columns)
                self._check_filters(cube, spec)
                by_source.setdefault(r["data_source"], []).append((r, SheetSpec(r["sheet_rank"], spec, r["focus_tab"])))
            except Exception as e:  # one bad spec must not stop the batch
                errors.append((r["sheet_rank"], r["chapter"], r["name"], error_text(e)))
        done = []
        for name, items in by_source.items():
            shared, failed = self._run(name, items)
            done += shared
            errors += failed
        return done, [e[1:] for e in sorted(errors)]

    def _run(self, source: str, items: list[tuple]) -> tuple[list[SharedSheets], list[tuple]]:
        """One aggregate for all sheets of a source; if it fails, halves are run
        apart, so that what goes wrong stays with its own spec."""
        cube, codebook, index = self._source(source)
        try:
            sheets = SharedSheets(cube, codebook, [s for _, s in items], index)
            sheets.sparse  # noqa: B018  runs here
            return [sheets], []
        except Exception as e:
            if len(items) == 1:
                r = items[0][0]
                return [], [(r["sheet_rank"], r["chapter"], r["name"], error_text(e))]
        half = len(items) // 2
        parts = [self._run(source, x) for x in (items[:half], items[half:])]
        return [s for p in parts for s in p[0]], [e for p in parts for e in p[1]]

    def cells(self) -> DataFrame:
        names = self.ordered.select("sheet_rank", "sheet")
        parts = [s.cells() for s in self._planned[0]]
        if not parts:
            return self.spark.createDataFrame([], CELL_SCHEMA)
        return reduce(DataFrame.unionByName, parts).join(names, "sheet_rank").select(*CELL_SCHEMA.names)

    def notes(self) -> DataFrame:
        parts = [self._notes(s) for s in self._planned[0]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], NOTE_SCHEMA)

    def _notes(self, sheets: SharedSheets) -> DataFrame:
        rows = self.ordered.join(sheets.counts().withColumnRenamed("tab", "shown_tab"), "sheet_rank")
        description = masked_note(F.coalesce("description", F.lit("")), F.col("n_masked"), F.col("ref_total"))
        title = auto_title(F.col("shown_tab"), F.col("filter_map"), F.col("pivot_row"), F.col("pivot_col"), sheets.codebook.display_names())
        return rows.select("sheet", "sheet_rank", F.col("toc_chapter").alias("chapter"), "title", "headline",
                           F.col("shown_tab").alias("focus_tab"), "n_masked", "ref_total",
                           description.alias("description"), title.alias("auto_title"))

    def errors(self) -> DataFrame:
        return self.spark.createDataFrame(self._planned[1], ERROR_SCHEMA)

    def write(self, path: str, fmt: str = "parquet") -> None:
        """Report cells partitioned by sheet, plus toc, notes and errors."""
        self.cells().write.mode("overwrite").partitionBy("sheet").format(fmt).save(f"{path}/cells")
        self.toc().write.mode("overwrite").format(fmt).save(f"{path}/toc")
        self.notes().write.mode("overwrite").format(fmt).save(f"{path}/notes")
        self.errors().write.mode("overwrite").format(fmt).save(f"{path}/errors")
