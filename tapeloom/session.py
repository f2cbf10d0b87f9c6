"""Session construction and lineage cuts."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapeloom", cpus: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the session that spark-submit gives."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tapeloom-")
    return folder


def work_folder(spark: SparkSession) -> str:
    """A fresh subfolder for tables and stream state of one run."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a job at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to a Python worker. Spark counts rows otherwise, and ten thousand texts are tens of megabytes, several times over.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: The tables that ``cut_lineage`` has written for the innermost ``last_table``.
_meanwhile: ContextVar[list[DataFrame] | None] = ContextVar("meanwhile", default=None)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers are small from now on, whoever writes the frame, unless the session sets their bytes itself."""
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, None) or BATCH)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that feeds several branches as a table in the shared folder and read it back.

    Later plans start from the table: its size is known, columns prune, and a lost executor re-reads a file
    instead of recomputing what led to it. The shuffle files that led to it go at once, not when the driver
    next collects its garbage. Batches for Python workers are small meanwhile, unless the session sets their bytes itself.
    """
    spark = df.sparkSession
    path, before = work_folder(spark), {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH_BYTES)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH_BYTES, before[BATCH_BYTES] or BATCH)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    if _meanwhile.get() is not None:
        _meanwhile.get().append(table)
    return table


def last_table(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all tables that ``cut_lineage`` wrote for it are deleted."""
    outer = _meanwhile.set([])
    try:
        table = cut_lineage(make())
        made = _meanwhile.get()
    finally:
        _meanwhile.reset(outer)
    discard(*(t for t in made if t is not table))
    if _meanwhile.get() is not None:
        _meanwhile.get().append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more: what came of them has been written itself."""
    for table in tables:
        spark, path = table.sparkSession, table._written_to
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
