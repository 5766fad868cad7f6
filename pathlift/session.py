"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pathlift.sources import files

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pathlift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Small test data: keep all cores busy instead of merging everything into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder stands in only under a local master, where driver and executors are one process. On a
    cluster a missing setting is an error: each executor would write its steps to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="pathlift-steps-")
    return _FALLBACK[context.applicationId]


def steps_dir(spark: SparkSession) -> str:
    """The folder of everything this application stores on the way; ``remove_steps`` drops it."""
    return f"{shared_dir(spark).rstrip('/')}/pathlift-steps/{spark.sparkContext.applicationId}"


def remove_steps(spark: SparkSession) -> bool:
    """Drop what this application stored on the way. Results that still read it must be written elsewhere before."""
    return files.remove(spark, steps_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step that later steps read more than once, and go on from the written table.

    A parquet table in the shared folder: it outlives an executor, later steps plan against a plain scan instead
    of repeating everything before it, read only the columns they need, and know its size when joining.
    """
    spark = df.sparkSession
    path = f"{steps_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
