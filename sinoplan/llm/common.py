"""What several operators share: table reading, checkpoints, sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that travel to a Python worker in one batch.
ARROW_BYTES = 4 << 20

_TOOL: dict = {}


def in_bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send rows to Python workers in batches of bounded bytes, however long texts are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:  # what the session names itself stays
        conf.set(name, str(ARROW_BYTES))
    return df


def tool(name, make):
    """What ``make`` makes, remembered in this worker until another operator's tool is asked for: a worker holds one at a time."""
    if name not in _TOOL:
        _TOOL.clear()
        give_back()
        _TOOL[name] = make()
    return _TOOL[name]


def give_back() -> None:
    """Return memory that a finished task left unused to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run, *after):
    """A worker's function over batches that gives memory back when its task ends, and calls ``after`` before.

    Batches without a row are left out: the JVM cannot read those that a filter has emptied.
    """

    def whole_task(batches):
        try:
            yield from (batch for batch in run(batches) if batch.num_rows)
        finally:
            for f in after:
                f()
            give_back()

    return whole_task


def returning(f):
    """A worker's function of one group, or of a group of two tables, that gives memory back when it is done."""

    def freed(*args):
        try:
            return f(*args)
        finally:
            give_back()

    if f.__code__.co_argcount == 3:
        return lambda key, left, right: freed(key, left, right)
    return lambda key, table: freed(key, table)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any path Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset one is made on a single machine (tests, a laptop); on a cluster it is an error,
    since a folder of the driver's is not seen by executors.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, wherever it is kept."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole(text_col: str):
    """The text, empty where it is null."""
    return F.coalesce(F.col(text_col), F.lit(""))
