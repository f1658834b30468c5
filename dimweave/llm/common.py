"""Helpers the training-data operators share: input tables, written intermediates, text keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimweave.session import checkpoint_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so their Python workers can import it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    # the driver serves this file to the executors as long as the session lives
    archive = Path(tempfile.mkdtemp(prefix="dimweave-"), "dimweave_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
            packed.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)


_KEPT: dict = {}


def kept_in_worker(name, make):
    """``make()``, kept under ``name`` for later tasks of a reused Python worker, until another name is asked for."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    """Free what the tasks of an earlier operator have kept in this Python worker."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (any path or store that Spark reads)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and return the reread table.

    The written table cuts the lineage, survives a lost executor, and has a size Spark knows, so
    a later join is broadcast only below Spark's own byte bound.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text; NULL reads as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def is_training_row(key: Column) -> Column:
    """True for rows labels may be learned from: crc32(key as text) mod 4 is not 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 != 2


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or ``wanted`` with underscores added until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def at_most(df: DataFrame, count_col: str, limit: int) -> DataFrame:
    """The rows with the greatest counts, at most ``limit``: all from the lowest count on for which they are so few.

    Rows are counted in steps of a quarter of a power of two, some hundred steps whatever the data.
    """
    step = F.floor(4 * F.log2(F.col(count_col).cast("double")))
    taken, least = 0, float("inf")
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > limit:
            break
        least = r["step"]
    return df.where(step >= F.lit(least))
