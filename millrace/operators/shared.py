"""Rows on their way through the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import MillraceError

#: Folders that nothing has deleted yet; they go when the process ends.
_left: dict[str, SparkSession] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def new_folder(spark: SparkSession) -> str:
    """A path in the folder named by spark.checkpoint.dir, on a local master else in a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise MillraceError("configure", "no_shared_folder", "spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    path = f"{base.rstrip('/')}/load-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def put(df: DataFrame, path: str, most: int = 0) -> None:
    """Add rows to a folder, in files of `most` rows; columns go by position, as their names may differ in case only."""
    df.toDF(*(f"c{i}" for i in range(len(df.columns)))).write.option("maxRecordsPerFile", most).mode("append").parquet(path)


def get(like: DataFrame, *paths: str) -> DataFrame:
    """Rows that put() wrote, with the columns of `like`."""
    fields = T.StructType([T.StructField(f"c{i}", f.dataType, True, f.metadata) for i, f in enumerate(like.schema)])
    return like.sparkSession.read.schema(fields).parquet(*paths).toDF(*like.columns)


def files(df: DataFrame) -> list[str]:
    return [urllib.parse.unquote(f) for f in df.inputFiles()]


def discard(path: str) -> None:
    spark = _left.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _leave() -> None:
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            discard(path)
