"""Tables written between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.session import ship


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and the next task may be another's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: The folder, below the application's, that tables of a running piece of work are staged in.
_scope = contextvars.ContextVar("scope", default="")
_rested = 0.0
#: Seconds between two calls of ``rest`` at least.
PAUSE = 5.0


def rest(spark: SparkSession) -> None:
    """Let executors give back heap that finished work has left, before Python workers of the next step need the memory.

    An executor's heap grows with the largest step and keeps that size; a collection between steps lets it shrink. One
    tiny task for each core, and no more than one round in ``PAUSE`` seconds.
    """
    global _rested
    if time.monotonic() - _rested < PAUSE:
        return
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, numPartitions=cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
    _rested = time.monotonic()


#: Rows of an Arrow batch; a batch of texts is held by the executor and by its Python worker, in a buffer each.
BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH`` rows in sessions that have Spark's own 10,000, which is tens of megabytes of texts a task.

    The setting is the session's and stays: plans are made when their results are asked for, long after this call. A
    caller's own number is left alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one, ``spark.checkpoint.dir``.

    Only where that is unset and executors run on this machine, as in tests, a folder of our own takes its place; on a
    cluster that would be a disk of each machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="prismet-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/prismet-{spark.sparkContext.applicationId}{_scope.get()}"


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scoped(spark: SparkSession):
    """Tables staged inside go to a folder of their own, which is deleted at the end; gives the folder outside, for what stays."""
    outside = shared_dir(spark)
    token = _scope.set(f"{_scope.get()}/scope-{uuid.uuid4().hex}")
    inside = shared_dir(spark)
    try:
        yield outside
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inside)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has staged: for the end of a program, when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, so a lost executor costs one read."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of the finished job go as soon as the driver drops its handles on them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    rest(spark)
    return spark.read.schema(df.schema).parquet(path)


def default_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
