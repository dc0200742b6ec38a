"""Session defaults and the two things every iterative job needs: a place to
cut lineage, and a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benches; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(master)
        .appName("bomspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see. Taken from ``spark.checkpoint.dir``; only a
    local-mode session may fall back to a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "local").startswith("local"):
        made = tempfile.mkdtemp(prefix="bomspark-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when the query has ended, not
    when the driver happens to collect its garbage. For queries whose result is
    written: a long loop then holds one round's files instead of all."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that survive the loss
    of any executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    with shuffles_removed(spark):
        return df.checkpoint(eager=True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Rows written once, packed, to the shared folder: for narrow frames that
    cost a parse of their documents and are read several times."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
