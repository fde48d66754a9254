"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "corefold") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings one."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that outlives executors: ``spark.checkpoint.dir`` of the
    session. Only where none is named (tests) a temporary one is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="corefold-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of one loop round or of a table used many times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


PACKED_ROWS = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Narrow rows in no more partitions than they need: every task that sends rows
    leaves files of its own, however few they are."""
    return df.coalesce(max(8, rows // PACKED_ROWS))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: lineage ends here. The shuffle
    files that made them are removed at once, as nothing reads them again."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written (checkpointed) table whose counted rows are
    within the limit; a larger one is left to the shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
