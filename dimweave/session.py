"""Session settings the plans are tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the plans rely on. AQE re-plans joins from runtime sizes (a shuffle join whose
# side turns out small becomes a broadcast), coalesces small shuffle partitions and splits
# skewed ones, so one hot demand or value id does not become one straggler task.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.ansi.enabled": "true",
    # A stage of the dimension holds many sorts (a join or window per attribute), and each takes a page
    # at least; with the default of up to 64 MB they can use up a task's share of a small heap.
    "spark.buffer.pageSize": "4m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dimweave") -> SparkSession:
    """A local session for tests and the bench: UI off, plan settings on.

    A checkpoint folder is set only here, for local runs; on a cluster the session's own
    ``spark.checkpoint.dir`` (a shared folder) is used, see ``checkpoint_dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DIMWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dimweave-ckpt-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="dimweave-warehouse-"))
    )
    for k, v in PLAN_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    On a cluster that setting names a folder every executor reaches and it is used as is; without
    it this raises. Only a local session (one process, one disk) gets a scratch folder, once.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dimweave-ckpt-"))
        path = sc.getCheckpointDir()
    return path


def cluster_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of attribute and stage tables.

    Shuffle partitions are sized so that one partition of the largest shuffle (at most the size
    of the scanned EAV columns) holds about ``partition_bytes``, and never fewer than 3 per core,
    so tasks stay spillable and AQE still has room to coalesce or split them. File splits match
    the same size. Apply with ``SparkSession.builder.config(map=cluster_conf(...))``.
    """
    shuffle = max(3 * cores, -(-input_bytes // partition_bytes))
    return {
        **PLAN_CONF,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
    }
