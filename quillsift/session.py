"""Session settings and the shared folder that stages write to."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Where spark.checkpoint.dir is unset and the master is local, one folder per application.
_local_dirs: dict[str, str] = {}


def local_session(cpus: str = "*", partitions: int = 8, app: str = "quillsift") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; a cluster must name a shared folder, because
    a machine-local one is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="quillsift-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quillsift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored_path(spark: SparkSession, name: str, source: str) -> str:
    """The path in the shared folder of what this application made from one source, for others to reuse."""
    digest = hashlib.sha256(source.encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/quillsift/{spark.sparkContext.applicationId}/{name}-of-{digest}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps then read that table instead of recomputing, also after executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table scan in at least as many tasks as there are cores, for the heavy work that follows.

    A table in one small file is one task however many cores wait. Larger tables have tasks enough
    and are left as they are. Use it on a scan: counting the tasks of a plan with shuffles runs them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
