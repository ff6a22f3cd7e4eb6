"""Dataset catalogue: the Parquet datasets under a root folder, their file
metadata and dataset type from the file name. What the datasets hold, and which
are enabled, is a matter of the manifest (``manifest``).

File listing runs as a Spark scan of the ``binaryFile`` source with only
metadata columns selected, so file contents are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.functions import DATASET_PREFIXES, basename, data_suffix, dataset_type, epoch_text


def list_datasets(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """(path, name, modified, modified_text, size, dataset_type, below_data) of every dataset
    below ``root`` (recursive). A dataset is a file with the suffix or a folder
    with it, whose part files count together."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*{suffix}").load(root)
             .select("path", "modificationTime", "length"))
    mark = F.lit(suffix)
    steps = F.split("path", "/")
    depth = F.array_position(F.transform(steps, lambda x: x.endswith(mark)), True).cast("int")
    owner = F.concat_ws("/", F.slice(steps, 1, depth))
    found = files.groupBy(owner.alias("path")).agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("size"))
    return found.select("path", basename("path").alias("name"), "modified", epoch_text("modified").alias("modified_text"),
                        "size", dataset_type("path").alias("dataset_type"), data_suffix("path").alias("below_data"))


def require_dataset_types(catalog: DataFrame) -> DataFrame:
    """The catalogue, failing when it runs if a dataset has no known type."""
    known = F.lit(", ".join(DATASET_PREFIXES))
    message = F.concat(F.lit("no dataset type for "), "name", F.lit("; known prefixes: "), known)
    return catalog.withColumn("dataset_type", F.coalesce("dataset_type", F.raise_error(message).cast("string")))
