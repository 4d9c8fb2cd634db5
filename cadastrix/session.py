"""Session helpers shared by every query; nothing here touches machine-local folders on a cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PLAN_TEXT = "spark.sql.maxPlanStringLength"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder, with its parquet schema as stored."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one serves a local session; a cluster without it raises."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cadastrix-"))
    return context.getCheckpointDir()


@contextmanager
def short_plan_texts(spark: SparkSession, most: int = 8192) -> Iterator[None]:
    """Plan texts kept for display are cut while jobs with many steps run: with adaptive execution the driver would write and keep a
    whole text of every plan at each change of it. A length set by the user stays."""
    known = (spark.conf.get(PLAN_TEXT) or "").rstrip("b")
    own = not (known.isdigit() and int(known) > 1 << 30)  # the default is the longest text there can be
    if not own:
        spark.conf.set(PLAN_TEXT, str(most))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(PLAN_TEXT)


def release(spark: SparkSession) -> None:
    """What steps that are done have left in the driver (plans, task binaries, broadcast blocks) is collected once its heap has grown past
    a third of its limit, and the free heap goes back to the system. Shuffle files of those steps are removed by this, too: Spark does so
    when the driver happens to collect their last reference, which in a job of many small steps is late."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * 3 > runtime.maxMemory():
        runtime.gc()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    with short_plan_texts(spark):
        cut = df.checkpoint(eager=eager)
    release(spark)
    return cut


def spread(df: DataFrame, split_mb: int = 32) -> DataFrame:
    """A small input comes in fewer splits than there are cores; before costly narrow work its rows are dealt out evenly. An input of
    more than ``split_mb`` for each shuffle partition, or of unknown size, keeps its splits and is not shuffled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(parts) if size < parts * split_mb << 20 else df


@contextmanager
def no_own_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins are merged, not broadcast, unless a join asks for it: a broadcast table is built in the driver, and each takes pages of its
    heap however small it is. For chains of many joins between tables that grow with the data."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def merged_checkpoint(df: DataFrame) -> DataFrame:
    """``checkpoint`` of a table whose joins are merged."""
    with no_own_broadcasts(df.sparkSession):
        return checkpoint(df)


def brief_checkpoint(df: DataFrame) -> DataFrame:
    """``merged_checkpoint`` of a step over distinct names or forms, of which there are few beside the rows, or of a join over all columns of
    a form: generating and compiling code for such a step costs the driver more than the step takes, so it runs without whole-stage code."""
    spark, key = df.sparkSession, "spark.sql.codegen.wholeStage"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return merged_checkpoint(df)
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
