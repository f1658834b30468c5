"""Write an intermediate result once to the shared checkpoint folder, read it back, remove it.

Used where one intermediate feeds several branches whose filters Catalyst would push below the shared
shuffle (so each branch would read the sources again). The files live under ``spark.checkpoint.dir``
(a folder every executor reaches), so the read side survives the loss of the executors that wrote it.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dimweave.session import checkpoint_dir


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer; nothing happens when it is gone or Spark has ended."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@dataclass(frozen=True)
class Stored:
    """A written table: ``df`` reads it, ``remove`` deletes its files when the job is done."""

    df: DataFrame
    path: str

    def remove(self) -> None:
        remove_path(self.df.sparkSession, self.path)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.remove()


def write_shared(df: DataFrame, name: str, partition_by: str | None = None) -> Stored:
    """Write ``df`` now, as Parquet under the checkpoint folder.

    With ``partition_by`` each value gets its own folder, so a filter on that column reads only the
    matching files; the rows are rebalanced by it first, so there are a few files of a good size per
    value rather than one per task. What is not removed before goes when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/dimweave/{name}-{uuid.uuid4().hex}"
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by).parquet(path)
    else:
        df.hint("rebalance").write.mode("errorifexists").parquet(path)
    stored = Stored(spark.read.schema(df.schema).parquet(path), path)
    atexit.register(_remove_quietly, stored)
    return stored


def _remove_quietly(stored: Stored) -> None:
    try:
        stored.remove()
    except Exception:  # the session may have ended before
        pass
