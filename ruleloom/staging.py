"""Staged tables: intermediate results written once to the cluster's shared folder.

Iterative operators (level-wise mining, coverage rounds) cut their lineage by writing a table and reading
it back. A staged table outlives lost executors, is computed once however often it is read, and gives Catalyst
its true size, so that joins with it are broadcast only when they are in fact small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir` of the session, else the context's checkpoint folder.

    Only a local-mode session without either gets a temporary folder of its own; a cluster must name one,
    because a machine-local folder is not visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ruleloom-")
    return _LOCAL_ROOTS[app]


def _folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/ruleloom/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables this application has staged. DataFrames built on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; `drop_staged` deletes what is written there."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """Stage `df` and return aggregates over its rows, taken while they are written. `rows` is always among them."""
    seen = Observation()
    table = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in facts.items()]), name)
    return table, seen.get


def spread(table: DataFrame, rows: int | None = None, rows_per_task: int = 2000) -> DataFrame:
    """Use all cores on a table read from few files, as far as its rows are worth a task.

    Tables with at least as many partitions as cores, which is every large one, are left as they are. For tables read
    straight from files only: counting partitions must not run anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    wanted = cores if rows is None else min(cores, -(-rows // rows_per_task))
    return table.repartition(wanted) if table.rdd.getNumPartitions() < wanted else table
