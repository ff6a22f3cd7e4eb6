"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Session settings the engine is designed around. On a cluster these come from
# the job submission; locally they are applied by ``local_session``.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (~1000 executors, ~100 TB of microdata). Splits of
# 256 MB keep scan tasks in the tens of thousands; the initial shuffle width is
# high and AQE coalesces it to ~256 MB partitions after measuring; partitions
# more than 5x the median (and over 512 MB) are split by the skew-join rule;
# lookups up to 64 MB are broadcast by the planner.
CLUSTER_CONF = {
    **{k: v for k, v in RECOMMENDED_CONF.items()},
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def apply_conf(spark: SparkSession, conf: dict[str, str] = CLUSTER_CONF) -> None:
    """Apply runtime SQL settings to a session (static ones belong in the job
    submission)."""
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "statcube") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) is a private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # unset only in local tests: a private folder on this machine
        configured = tempfile.mkdtemp(prefix="statcube-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_WRITTEN: list[str] = []


def drop_intermediates(spark: SparkSession) -> int:
    """Deletes the tables that ``cut_lineage`` wrote so far in this process, in
    any store; call it when no result that reads them is needed any more."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(hadoop).delete(path, True))
    return n


def cut_lineage(df: DataFrame, **measures: Column) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and
    read it back.

    Later jobs (probe pass, key list, final plan) scan the written table with
    filter pushdown and column pruning instead of recomputing the lineage, and
    a lost executor re-reads files rather than rebuilding the cube. ``measures``:
    aggregates of the rows, worked out in the same pass and returned as well.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/statcube-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    seen = Observation()
    rows = df.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else df
    rows.write.mode("error").parquet(path)
    # the schema is known: no footer reads to infer it
    held = spark.read.schema(df.schema).parquet(path)
    return (held, seen.get) if measures else held
