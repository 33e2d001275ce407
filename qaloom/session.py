"""Session construction and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "qaloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; cluster settings come from the submitter, not from here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": os.environ.get("QALOOM_UI", "false"),
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the session's checkpoint folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named)
    return (named or known.get()).rstrip("/")


def ready(spark: SparkSession) -> SparkSession:
    """For entry points: on one machine without a named folder the session gets a new one of its own; a cluster has to name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and (context.master + "[").startswith("local[") and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="qaloom-"))
    return spark


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def folder_of_its_own(spark: SparkSession, name: str) -> Iterator[str]:
    """A new path in the shared folder, deleted at the block's end: for files that are written and read back inside."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_folder(spark, path)


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to a checkpoint, so that what they were read from can go.

    Spark deletes the checkpoint when nothing refers to it any more (``cleanCheckpoints``).  The result is read as a plain source:
    a checkpoint keeps its plan's size estimate, which multiplies over joins from one checkpoint to the next.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    out = rows.checkpoint(eager=True)
    rdd = out._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, out._jdf.schema(), False), spark)
