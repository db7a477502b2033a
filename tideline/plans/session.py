"""What a session needs so that its Python workers can import this package."""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' path. On a cluster whose nodes don't have it there, ship the package with --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in what driver and executors share: spark.checkpoint.dir. Where that is unset, on this machine, but only
    if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file:///tmp/checkpoints/tideline').rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and lost executors cost nothing. by: a column whose values have a
    folder each, so that a filter on it reads no other rows."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """df as a table in the shared folder, in n buckets of the column `by`: windows, groups and joins by it shuffle no more."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.option("compression", "zstd").option("path", shared_folder(df.sparkSession, name)).bucketBy(n, by).saveAsTable(table)
    return df.sparkSession.table(table)


def laid(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """df in n buckets of the column `by`, without a shuffle: for rows whose tasks hold whole buckets already (else a bucket has more files)."""
    table, path = f"{name}_{uuid.uuid4().hex}", shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._written, out._table, out._buckets = path, table, n
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by written() or laid() that nothing reads any more."""
    for table in tables:
        if (name := getattr(table, "_table", None)) is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
        if (folder := getattr(table, "_written", None)) is not None:
            path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(reachable(spark), sf_dir)

    return run
