"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import threading
import urllib.parse
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new local one is set, on a local master only."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python while a table is written: both sides hold a few of them a task.
BATCH_BYTES = 4 << 20
#: Settings while a table is written. Nothing reads a write's shuffle files once it has ended, so they go at once.
_WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of _WRITING for what is planned and run inside; the session's own return after."""
    was = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


class _Tables(threading.local):
    """Tables of this thread: `stage` since the last release(), `all` of them until they are deleted."""

    def __init__(self) -> None:
        self.stage: list[str] = []
        self.tracking = False


_tables = _Tables()
#: Written tables that nothing has deleted yet; they go when the process ends.
_left: dict[str, SparkSession] = {}


@atexit.register
def _leave() -> None:
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        discard(spark, path)


@contextmanager
def tracked() -> Iterator[None]:
    """Tables that spill() writes inside belong to this stage and go with release()."""
    was, _tables.tracking = _tables.tracking, True
    try:
        yield
    finally:
        _tables.tracking = was


def owned(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, deleted with the stage that asked for it or else when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    if _tables.tracking and not keep:
        _tables.stage.append(path)
    return path


def spill(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder; the table read back, and its path.

    A written table cuts the lineage: a lost executor costs no recomputation of what precedes it.
    """
    spark = df.sparkSession
    path = owned(spark, name, keep)
    with writing(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _left.pop(path, None)


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the tables of this thread's stages before, but those that `docs` still reads.

    Only for when the results of these stages are written, as the pipeline does between its stages.
    """
    read = {urllib.parse.unquote(f) for f in docs.inputFiles()}
    base = lambda path: re.sub(r"^[a-z0-9+.-]+:/*", "/", path) + "/"
    used = {p for p in _tables.stage if any(base(f).startswith(base(p)) for f in read)}
    discard(spark, *(p for p in _tables.stage if p not in used))
    _tables.stage[:] = [p for p in _tables.stage if p in used]
    clean_shuffles(spark)


def clean_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, which wait for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()
