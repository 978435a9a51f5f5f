"""Tables that outlive a task: Parquet in the folder that all executors share.

The session names that folder in ``spark.checkpoint.dir``. Only a local session
(one machine) may leave it unset; then a temporary folder of that machine serves,
one for each application.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; raises where a cluster's session does not name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        base = _LOCAL[context.applicationId]
    return f"{base}/evidentia-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", codec: str = "zstd") -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, which cuts its lineage, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", codec).parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def made() -> int:
    """How many tables written() has made so far."""
    return len(_MADE)


def since(mark: int) -> list[str]:
    """Paths of the tables made after made() gave mark, whether or not they were dropped."""
    return _MADE[mark:]


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that no later step reads, with the folders made for them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
