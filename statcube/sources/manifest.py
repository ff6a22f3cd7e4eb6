"""Manifest of a data folder: what each dataset holds, noted when it is written.

Writing a dataset works out its profile in the same pass (observed metrics of
the write job: per column its missing values, smallest and largest value, and a
checksum that does not depend on row order). The profile goes to the folder's
manifest, in a file of its own, so that datasets can be written at once; the last
one of a name counts. The catalogue is a query over the manifest: no data file
is listed or opened for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.functions import dataset_type

FOLDER = "_manifest"
SCHEMA = ("dataset string, written timestamp, position int, column string, kind string, n_rows long, n_nulls long, "
          "min_text string, max_text string, checksum decimal(38,0)")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "long"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "double"
    return {"DateType": "date", "TimestampType": "timestamp", "TimestampNTZType": "timestamp", "BooleanType": "boolean"}.get(type(dtype).__name__, "text")


def value_text(c: Column, dtype: T.DataType) -> Column:
    """One text for equal values: numbers with a fraction to four places,
    times in microseconds."""
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return c.try_cast("decimal(28,4)").cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast("string")


def profile_metrics(df: DataFrame) -> list[Column]:
    """The digest of a value is a long below 2^32, summed in halves of 16 bits: a
    sum of decimals works out its input more than once a row, and one sum of
    longs overflows at some four billion rows."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        digest = F.conv(F.substring(F.md5(value_text(c, f.dataType).cast("binary")), 1, 8), 16, 10).cast("long")
        out += [F.count(c).alias(f"n_{i}"), F.sum(F.shiftright(digest, 16)).alias(f"c_hi_{i}"), F.sum(digest.bitwiseAND(F.lit(65535))).alias(f"c_lo_{i}"),
                value_text(F.min(c), f.dataType).alias(f"lo_{i}"), value_text(F.max(c), f.dataType).alias(f"hi_{i}")]
    return out


def checksum(got: dict, i: int) -> Decimal:
    """The sum of the digests of column ``i``, from its halves."""
    return Decimal(((got[f"c_hi_{i}"] or 0) << 16) + (got[f"c_lo_{i}"] or 0))


def write_dataset(df: DataFrame, root: str, name: str) -> str:
    """``df`` as ``<root>/<name>.parquet``, with its profile in the manifest."""
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}.parquet"
    seen = Observation()
    df.observe(seen, *profile_metrics(df)).write.mode("overwrite").parquet(path)
    got = seen.get
    rows = [(name, i, f.name, kind_of(f.dataType), got["n_rows"], got["n_rows"] - got[f"n_{i}"], got[f"lo_{i}"], got[f"hi_{i}"], checksum(got, i))
            for i, f in enumerate(df.schema.fields)]
    kinds = "dataset string, position int, column string, kind string, n_rows long, n_nulls long, min_text string, max_text string, checksum decimal(38,0)"
    noted = spark.createDataFrame(rows, kinds).withColumn("written", F.current_timestamp()).coalesce(1)
    noted.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{root.rstrip('/')}/{FOLDER}/{uuid.uuid4().hex}")
    return path


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset and column, as last written."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/{FOLDER}")
    last = rows.groupBy("dataset").agg(F.max("written").alias("written"))
    return rows.join(last, ["dataset", "written"])


def catalogue(spark: SparkSession, root: str, disabled: Sequence[str] | DataFrame = ()) -> DataFrame:
    """One row per dataset that is not disabled (all are enabled by default):
    type by its name, size, checksum, and its place in each of the three orders
    a catalogue is shown in (newest first, name ascending, name descending)."""
    if not isinstance(disabled, DataFrame):
        disabled = spark.createDataFrame([(n,) for n in disabled], "name string")
    sets = read_manifest(spark, root).groupBy(F.col("dataset").alias("name")).agg(
        F.max("written").alias("written"), F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_nulls").alias("n_nulls"), F.sum("checksum").cast("decimal(38,0)").alias("checksum"))
    kept = sets.join(disabled.select("name").distinct(), "name", "left_anti").withColumn("dataset_type", dataset_type("name"))
    # one row a dataset: a folder's datasets are ranked together
    by = {"by_time": [F.col("written").desc(), F.col("name")], "by_name": [F.col("name")], "by_name_desc": [F.col("name").desc()]}
    return kept.withColumns({k: F.row_number().over(Window.orderBy(*o)).cast("long") for k, o in by.items()})
