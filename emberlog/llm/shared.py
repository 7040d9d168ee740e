"""Tables written to the shared folder that the session names, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written within each open ``cleared``.
_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a session of one machine gets a temporary one; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/emberlog-{uuid.uuid4().hex}"


def written(df: DataFrame, keep: bool = False) -> tuple[DataFrame, str]:
    """The same rows, read back from Parquet in the shared folder, and its path; one to keep outlives ``cleared``."""
    path = folder(df.sparkSession)
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def few(df: DataFrame) -> DataFrame:
    """The same rows in an eighth as many tasks as a shuffle has, for tables that are small beside texts: a file costs more than its rows."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written inside, at its end; nothing lazy that reads them may leave."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


#: Rows that Spark hands to a Python worker at once: texts are long, and a batch is held several times over on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; a smaller setting stays. Plans are lazy, so the setting has to outlive the call."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
