"""Session helpers: a local session for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int | str = 8, app: str = "incidentlake", **conf: str) -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.scheduler.mode", "FAIR")
        # small test tables would otherwise be merged into one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    The folder is handed to the context as its checkpoint folder once per session.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="incidentlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Small constant table as an in-plan relation, whose exact size the optimizer knows."""
    fields = to_arrow_schema(StructType.fromDDL(ddl))
    columns = list(zip(*rows)) or [()] * len(fields)
    table = pa.table([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)
    return spark.createDataFrame(table, ddl)


def materialized(df: DataFrame) -> DataFrame:
    """Checkpoint of a frame that many passes read; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, by: str, least: int) -> DataFrame:
    """A frame of ``rows`` rows that many passes work on, dealt evenly by a hash of ``by``: tasks of ``least`` rows, at most two a core.

    Spark sizes partitions by bytes, which says nothing of the work on a row.
    """
    parts = min(-(-rows // least), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(1, parts), by)


def concurrently(spark: SparkSession, jobs: list[Callable], most: int = 4) -> list:
    """Results of independent jobs, in their order, at most ``most`` of them under way at a time.

    Each runs in a scheduler pool of its own, so with ``spark.scheduler.mode`` FAIR they share the
    cores evenly; otherwise the later ones take what the earlier ones leave free.
    """

    def pooled(i: int, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{i % most}")
        return job()

    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        tasks = [pool.submit(inheritable_thread_target(spark)(partial(pooled, i, job))) for i, job in enumerate(jobs)]
        return [task.result() for task in tasks]
