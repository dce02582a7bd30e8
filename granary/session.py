"""Session helpers: local test sessions and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_root: list[str] = []


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("granary")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _local_root:
        root = tempfile.mkdtemp(prefix="granary-")
        _local_root.append(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _local_root[0]


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the shared folder, grouped by application for later removal."""
    return f"{shared_root(spark)}/granary-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def fill_cores(df, *keys: str):
    """Spread a scan that has fewer partitions than the cluster has cores.

    For costly row-wise work on small inputs or files of few row groups; large
    inputs already have enough partitions and pass unchanged, and so do plans
    with a shuffle of their own.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def sized(df, purpose: str = "lookup"):
    """A lookup written once before it is joined.

    The optimizer then knows its real size: it is broadcast only below
    ``spark.sql.autoBroadcastJoinThreshold``, and the large side of the join is
    not shuffled just because the size was unknown.
    """
    return materialize(df, purpose)


def materialize(df, purpose: str = "stage"):
    """Write a multiply used result once and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
