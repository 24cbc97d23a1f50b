"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session has no checkpoint folder, and only in local mode.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: Spark drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at a time: of whole texts, Spark's 10,000 are tens of MB in each task, in the JVM and in the worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


@contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session within a block, then as they were."""
    had = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, and leaves no shuffle files. batch_rows: of Python batches, if not the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidewatch/{name}-{uuid.uuid4().hex}"
    with conf(spark, **{CLEANUP: "true"}, **({BATCH: str(batch_rows)} if batch_rows else {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in frames:
        jvm, path = df.sparkSession.sparkContext._jvm, _PATHS.pop(df)
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def chunks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about limit characters; a longer text is a range of its own."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > begin and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
