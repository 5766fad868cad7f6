"""Folders as the file system lists them: no file is opened and no job is started."""

from __future__ import annotations

from urllib.parse import unquote

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: The folder of rows without a value in the partition column (fixed value).
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _located(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder with everything in it; False where there is none."""
    fs, where = _located(spark, path)
    return fs.delete(where, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted; none where its beginning does not exist. One listing on the driver."""
    fs, where = _located(spark, pattern)
    found = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(fs, where).mkString("\n")
    return sorted(found.split("\n")) if found else []


def named(path: str) -> dict[str, str | None]:
    """The ``name=value`` parts of a path."""
    parts = [p.split("=", 1) for p in path.split("/") if "=" in p]
    return {k: None if v == NO_VALUE else unquote(v) for k, v in parts}


def partition_values(spark: SparkSession, path: str, field: str) -> list[str]:
    """Values of the first partition column of a stored table, null left out."""
    values = (named(p.rsplit("/", 1)[1])[field] for p in matching(spark, f"{path.rstrip('/')}/{field}=*"))
    return [v for v in values if v is not None]


def read_folders(spark: SparkSession, schema, root: str, folders: list[str]) -> DataFrame:
    """Chosen folders of one table, with the partition columns their paths name below ``root``."""
    return spark.read.schema(schema).option("basePath", root).parquet(*folders)
