"""Session settings and the shared work folder. On a cluster, executors, memory and parallelism come
from spark-submit."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: rows that ``packed`` shuffles at once, and its rounds at most: each reads all rows again
AT_ONCE, ROUNDS = 5_000_000, 3


def build_session(app_name: str = "barloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, a
    folder beside the warehouse tables, unless that lies on one machine of several."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse.rstrip("/") + "/_work"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize a result that several later steps read, so that it is computed once and a lost
    executor costs no recomputation of everything upstream."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files behind; else those lie until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder; unique, so that reruns never meet."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table in the work folder: compressed, and read back by
    column. The folder's owner clears it; names are unique, so that reruns never meet."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(
    rows: DataFrame, name: str, by: list[str], n: int, make: Callable[[DataFrame], DataFrame] = lambda part: part, at_once: int = AT_ONCE
) -> DataFrame:
    """``make(rows)`` like ``written``, for large tables on small disks: closely compressed, and without the shuffle files of its making.
    Of more than ``at_once`` rows (there are ``n``), some follow after the others, so that their shuffles don't share the disk: rounds
    go by the values of ``by``, over which ``make`` may gather rows, but not beyond."""
    spark = rows.sparkSession
    path, rounds = new_path(spark, name), max(1, min(ROUNDS, -(-n // at_once)))
    with shuffles_dropped(spark):
        for k in range(rounds):
            some = rows.where(F.pmod(F.xxhash64(*by), F.lit(rounds)) == k) if rounds > 1 else rows
            made = make(some)
            made.write.mode("append").parquet(path, compression="zstd")
    return spark.read.schema(made.schema).parquet(path)


def complete_table(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(context.hadoopConfiguration()).exists(marker)


def written_once(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """The table at ``path``, written if it is not there to its end: a step that a repeated run skips."""
    if not complete_table(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
