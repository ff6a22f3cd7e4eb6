"""Orderings of tabs, axis keys and report chapters, emitted as rank columns
so downstream consumers (and order-insensitive checks) can use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import numeric_text
from statcube.schema import YEAR_TAB
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook


def _with_label_rank(df: DataFrame, col: str, codebook: Codebook, out: str) -> DataFrame:
    ranks = codebook.label_ranks(df.sparkSession, col).select(
        F.col("label").alias(f"__lab_{out}"), F.col("rank").alias(out))
    return (df.join(ranks, F.col(col).cast("string") == F.col(f"__lab_{out}"), "left")
            .drop(f"__lab_{out}"))


def tab_order(df: DataFrame, tab: str, codebook: Codebook | None = None) -> DataFrame:
    """(tab, tab_rank) over the distinct non-null tabs.

    Codebook order when the tab has a code list (unknown labels last);
    DATA_YR descending; otherwise numbers ascending when every tab looks
    numeric, else text ascending.
    """
    tabs = df.select(tab).where(F.col(tab).isNotNull()).distinct()
    if codebook is not None and codebook.has_codes(tab):
        tabs = _with_label_rank(tabs, tab, codebook, "__rank")
        order = [F.col("__rank").asc_nulls_last(), F.col(tab).cast("string")]
    elif tab == YEAR_TAB:
        order = [F.col(tab).desc()]
    elif isinstance(df.schema[tab].dataType, T.NumericType):
        order = [F.col(tab)]
    else:
        all_numeric = tabs.agg(F.min(numeric_text(tab).cast("int")) == 1).scalar()
        tabs = tabs.withColumn("__num", F.when(all_numeric, F.col(tab).try_cast(T.DoubleType())))
        order = [F.col("__num").asc_nulls_last(), F.col(tab)]
    return ranked(tabs, [], order, "tab_rank").select(tab, "tab_rank")


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with the row number by ``order`` within each ``part``, for groups
    of any size: rows are range-partitioned and sorted (and stored, so that both
    uses below see the same ranges), numbered inside each range, and shifted by
    the rows of the ranges before it. Only one row per range and part is
    gathered per part."""
    part = list(part)
    ranges = df.repartitionByRange(*[F.col(p).asc_nulls_first() for p in part], *order)
    held = cut_lineage(ranges.withColumn("__range", F.spark_partition_id()))
    counts = held.groupBy(*part, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(part)], F.col("__range").alias("__r"),
                         F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = held.withColumn("__k", F.row_number().over(Window.partitionBy(*part, "__range").orderBy(*order)))
    on = F.col("__range") == F.col("__r")
    for i, p in enumerate(part):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    return inside.join(base, on).select(*df.columns, (F.col("__k") + F.col("__base")).cast("long").alias(out))


def axis_sort_columns(df: DataFrame, dims: Sequence[str], codebook: Codebook | None) -> tuple[DataFrame, list[Column]]:
    """Attach codebook ranks and return the sort expressions for axis keys:
    ranks of levels with code lists (level 0 first, unknown last), then the
    labels themselves."""
    order: list[Column] = []
    out = df
    for i, d in enumerate(dims):
        if codebook is not None and codebook.has_codes(d):
            out = _with_label_rank(out, d, codebook, f"__rank{i}")
            order.append(F.col(f"__rank{i}").asc_nulls_last())
    order += [F.col(d).asc_nulls_first() for d in dims]
    return out, order


def axis_order(cells: DataFrame, tab: str, dims: Sequence[str], total_flag: str,
               codebook: Codebook | None = None, out: str = "axis_rank") -> DataFrame:
    """(tab, dims…, total_flag, rank) for the distinct axis keys of each tab;
    the total key comes first."""
    keys = cells.select(tab, *dims, total_flag).distinct()
    keys, order = axis_sort_columns(keys, dims, codebook)
    return ranked(keys, [tab], [F.col(total_flag).desc(), *order], out).select(tab, *dims, total_flag, out)


def chapter_sort_columns(chapter: str | Column) -> list[Column]:
    """Natural order of chapters like 4-1-10: integer parts compared as a
    list; an empty chapter after all valid ones; invalid ones last, by text."""
    ch = F.trim(F.coalesce(F.col(chapter) if isinstance(chapter, str) else chapter, F.lit("")))
    parts = F.transform(F.split(ch, "-"), lambda x: x.try_cast(T.IntegerType()))
    valid = (ch != "") & F.forall(parts, lambda x: x.isNotNull())
    klass = F.when(valid, F.lit(0)).when(ch == "", F.lit(1)).otherwise(F.lit(2))
    return [klass, F.when(valid, parts), F.when(klass == 2, ch)]
