"""Index of a cube for the probes of the aggregate-aware filter.

Per grouping set (told by which dimensions it aggregates) the index lists the
values of each dimension it holds: a table of the size of the code lists, stored
beside the cube. A probe asks whether some row aggregates over a dimension under
filters on others. In a set where at most one filter leaves values out, the
lists answer that exactly; so they do where a filter finds no value. What is left
(two filters or more that each leave values out of the same set) is looked up in
the cube, within those sets only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statcube.functions import coerce_filter_values, conj
from statcube.operators.filters import Marker, as_list, is_null
from statcube.schema import dimension_columns
from statcube.session import cut_lineage

Conditions = list[tuple[str, tuple | None]]  # dimension, values it may have (None: any)


def probe_conditions(df: DataFrame, tab: str | None, rows: Sequence[str], cols: Sequence[str],
                     filters: Mapping[str, Sequence], probe: str = "prefix") -> list[tuple[str, Conditions]]:
    """(probed dimension, conditions on other dimensions it is probed under), as
    ``filters.probe_plan`` has them."""
    axes = set(as_list(tab)) | set(rows) | set(cols)
    base: Conditions = []
    probes = []
    for d in dimension_columns(df):
        if d in filters:
            base = [*base, (d, tuple(coerce_filter_values(df.schema[d].dataType, filters[d])))]
        if d in axes:
            base = [*base, (d, None)]
        else:
            probes.append((d, base))
    return [(d, base) for d, _ in probes] if probe == "full" else probes


class ProbeIndex:
    def __init__(self, cube: DataFrame, rows: DataFrame, marker: Marker = is_null):
        """``rows``: (aggregated, dim, value), as ``of`` makes them."""
        self.cube, self.rows, self.marker = cube, rows, marker
        self.dims = dimension_columns(cube)

    @staticmethod
    def entries(cube: DataFrame, marker: Marker = is_null) -> DataFrame:
        """(aggregated, dim, value): for each grouping set (bit i of ``aggregated``
        is set where it aggregates over dimension i) the values of its other
        dimensions, as text; a set's own row has no dim."""
        dims = dimension_columns(cube)
        bits = reduce(lambda a, b: a + b, [F.when(marker(d), F.lit(1 << i)).otherwise(0) for i, d in enumerate(dims)], F.lit(0))
        none = F.struct(F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("value"))
        held = [F.when(~marker(d), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"))) for d in dims]
        listed = F.filter(F.array(none, *held), lambda x: x.isNotNull())
        return cube.select(bits.cast("long").alias("aggregated"), F.inline(listed)).distinct()

    @classmethod
    def of(cls, cube: DataFrame, marker: Marker = is_null) -> ProbeIndex:
        return cls(cube, cut_lineage(cls.entries(cube, marker)), marker)

    def flags(self, specs: Sequence[list[tuple[str, Conditions]]]) -> list[list[bool]]:
        """For each spec's probes, whether a row that aggregates over the probed
        dimension exists under its conditions."""
        limits = list(dict.fromkeys((d, v) for probes in specs for _, conds in probes for d, v in conds if v is not None))
        aggs = [F.count_if(F.col("dim") == d).alias(f"all_{i}") for i, d in enumerate(self.dims)]
        for j, (d, values) in enumerate(limits):
            named = F.col("value").isin([F.lit(v).cast(self.cube.schema[d].dataType).cast("string") for v in values]) if values else F.lit(False)
            aggs.append(F.count_if((F.col("dim") == d) & named).alias(f"in_{j}"))
        sets = self.rows.groupBy("aggregated").agg(*aggs).collect()  # one row a grouping set

        def decide(probe: str, conds: Conditions) -> bool | list[int]:
            """True, False, or the sets in which it is open."""
            open_sets = []
            for s in sets:
                gone = {d for i, d in enumerate(self.dims) if s["aggregated"] >> i & 1}
                if probe not in gone or any(d in gone for d, _ in conds):
                    continue
                own = {(d, v): s[f"in_{limits.index((d, v))}"] for d, v in conds if v is not None}
                if not all(own.values()):
                    continue
                narrowed = {d for (d, _), n in own.items() if n < s[f"all_{self.dims.index(d)}"]}
                if len(own) == len({d for d, _ in own}) and len(narrowed) <= 1:
                    return True
                open_sets.append(s["aggregated"])
            return open_sets or False

        answers = [[decide(*p) for p in probes] for probes in specs]
        left = [(i, j, a) for i, row in enumerate(answers) for j, a in enumerate(row) if isinstance(a, list)]
        if left:
            found = self._look_up([(specs[i][j], a) for i, j, a in left])
            for (i, j, _), yes in zip(left, found):
                answers[i][j] = yes
        return answers

    def _look_up(self, open_probes: list) -> list[bool]:
        """The open probes, in one pass over the sets that they are open in."""
        def in_set(aggregated: int) -> Column:
            return conj(self.marker(d) if aggregated >> i & 1 else ~self.marker(d) for i, d in enumerate(self.dims))

        def limited(conds: Conditions) -> Column:
            return conj(F.col(d).isin(list(v)) if v else F.lit(False) for d, v in conds if v is not None)

        sets = sorted({a for _, found in open_probes for a in found})
        rows = self.cube.where(reduce(lambda a, b: a | b, [in_set(a) for a in sets]))
        got = rows.agg(*[F.coalesce(F.bool_or(limited(conds) & reduce(lambda a, b: a | b, [in_set(a) for a in found])), F.lit(False)).alias(f"h{i}")
                         for i, ((_, conds), found) in enumerate(open_probes)]).first()
        return [bool(got[i]) for i in range(len(open_probes))]
