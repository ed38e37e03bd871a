"""What the operators of this subpackage share: table access, written intermediate tables, code shipping."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope import session

#: Shuffle files of an intermediate job go as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a folder of our own; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        try:
            found = spark.conf.get("spark.checkpoint.dir")
        except Exception as error:  # the setting is unknown to this version or has no value
            if "spark.checkpoint.dir" not in str(error):
                raise
    if not found:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/sparkscope-shared"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkscope/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkscope/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A batch of texts is in memory several times over: in the JVM, in Arrow's pool, and as Python strings.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and their allocators keep what it freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, which gives its memory back at the end of a task."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns of our own beside the caller's."""
    taken = [c.lower() for c in df.columns]
    prefix = "_own_"
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return prefix


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, the session has these settings: for queries that are run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def eager_cleanup(spark: SparkSession):
    """Within it, every finished query drops its shuffle files; its result must have been written."""
    return settings(spark, {CLEANUP: "true"})


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a rerun of the reading tasks only, and Spark knows the size of what follows.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    with eager_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    roots = {os.path.dirname(f) for f in df.inputFiles()}
    for root in roots:
        if "/sparkscope/" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, and bound the batches that workers get."""
    for key, most in BATCH.items():
        spark.conf.set(key, most)
    session.ship(spark)


def utf8_length(text):
    """Bytes of a text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(values: list, limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of texts that hold about ``limit`` characters at most (one text at least)."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > limit:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)
