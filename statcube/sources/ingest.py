"""CSV deliveries -> Parquet datasets.

A delivery is a folder of CSV files (one dataset each, each with its own
columns). Every file is converted to a same-named Parquet dataset: the file
list is a folder listing (small), each conversion is a distributed read and
write of that file. Without a schema, ``ingest_delivery`` parses each file once,
as text, and works out the column types in that same pass.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.schema import is_unnamed
from statcube.sources.catalog import list_datasets
from statcube.sources.manifest import write_dataset


def read_delivery_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. With a schema: no inference pass. Without one,
    types are inferred from the whole file (as the delivery convention
    expects: integers with gaps become doubles). Index columns are dropped."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    extra = [c for c in df.columns if is_unnamed(c)]
    return df.drop(*extra) if extra else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def delivery_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
               .select("path"))
    return sorted(r["path"] for r in listing.toLocalIterator())


def convert_delivery(spark: SparkSession, folder: str, out_dir: str | None = None,
                     schemas: dict[str, T.StructType] | T.StructType | None = None, at_once: int = 8) -> list[str]:
    """Convert every CSV of ``folder`` to ``<out_dir>/<stem>.parquet`` (default:
    next to the CSV), several files at once (each is a Spark job of its own).
    ``schemas``: by file stem, or one for all files. Returns the written paths."""
    out_dir = (out_dir or folder).rstrip("/")

    def convert(path: str) -> str:
        stem = path.rsplit("/", 1)[-1].removesuffix(".csv")
        target = f"{out_dir}/{stem}.parquet"
        write_parquet(read_delivery_csv(spark, path, schemas if isinstance(schemas, T.StructType) else (schemas or {}).get(stem)), target)
        return target

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(convert, delivery_files(spark, folder)))


# Types a CSV column can have, narrowest first, and what text they take.
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
LATTICE = ["boolean", "long", "double", "date", "timestamp"]


def _fits(c: str, kind: str) -> Column:
    """The text is empty or a value of ``kind``."""
    text = F.col(f"`{c}`")
    if kind == "boolean":
        ok = F.lower(text).isin("true", "false")
    elif kind == "long":
        ok = text.rlike(r"^\s*[-+]?\d+\s*$") & text.try_cast("long").isNotNull()
    elif kind == "double":
        ok = text.rlike(NUMBER)
    elif kind == "date":
        ok = text.rlike(r"^\d{4}-\d\d-\d\d$") & text.try_cast("date").isNotNull()
    else:
        ok = text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d") & text.try_cast("timestamp").isNotNull()
    return text.isNull() | ok


def type_metrics(df: DataFrame) -> list[Column]:
    """Aggregates over text columns from which ``types_of`` tells their types."""
    out = []
    for i, c in enumerate(df.columns):
        out += [F.coalesce(F.bool_and(_fits(c, k)), F.lit(True)).alias(f"{k}_{i}") for k in LATTICE]
        out += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}"), F.count(F.lit(1)).alias(f"rows_{i}")]
    return out


def types_of(columns: list[str], seen: dict) -> dict[str, str]:
    """The narrowest type that takes every value of a column; integers with gaps,
    and columns without any value, are doubles (the delivery convention)."""
    out = {}
    for i, c in enumerate(columns):
        kind = next((k for k in LATTICE if seen[f"{k}_{i}"]), "string")
        gaps = seen[f"nulls_{i}"] > 0
        if seen[f"nulls_{i}"] == seen[f"rows_{i}"] or (kind == "long" and gaps):
            kind = "double"
        elif kind == "boolean" and gaps:
            kind = "string"
        out[c] = kind
    return out


def ingest_delivery(spark: SparkSession, folder: str, root: str, at_once: int = 4) -> dict[str, dict[str, str]]:
    """Every CSV dataset below ``folder`` as a typed dataset of ``root`` with its
    row in the manifest. Returns the types by dataset and column."""
    staged = f"{root.rstrip('/')}/_staged"

    def ingest(row) -> tuple[str, dict[str, str]]:
        name = row["name"].removesuffix(".csv")
        text = spark.read.option("header", True).option("mode", "FAILFAST").csv(row["path"])
        text = text.drop(*[c for c in text.columns if is_unnamed(c)])
        seen = Observation()
        text.observe(seen, *type_metrics(text)).write.mode("overwrite").parquet(f"{staged}/{name}")
        types = types_of(text.columns, seen.get)
        rows = spark.read.schema(text.schema).parquet(f"{staged}/{name}")
        write_dataset(rows.select(*[F.trim(F.col(f"`{c}`")).cast(t).alias(c) if t != "string" else F.col(f"`{c}`") for c, t in types.items()]), root, name)
        return name, types

    found = list_datasets(spark, folder, ".csv").select("name", "path").collect()  # one row a dataset
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return dict(pool.map(ingest, sorted(found)))
