"""Where the dimension goes: Parquet folders or a catalog table, written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dimweave.operators.materialize import remove_path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Write ``df`` as Parquet (Unicode column names are kept as they are)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Replace (or append to) a catalog table, e.g. the report's dimension table."""
    df.write.mode(mode).saveAsTable(name)


def write_ordered(df: DataFrame, path: str, by: Sequence[str], files: int | None = None, rows_per_file: int = 0) -> None:
    """Write ``df`` so that its files, read in the order of their names, give the rows ordered by ``by``.

    Rows are dealt into ranges of ``by`` and sorted within each; Spark numbers a range's files in the
    order of the ranges, and splits a range after ``rows_per_file`` rows (0: never). The order thus
    outlives the write, and no task sees more than its range. NULLs come first.
    """
    columns = [F.col(f"`{c}`").asc_nulls_first() for c in by]
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    dealt.sortWithinPartitions(*columns).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_ordered`` with ``file_name`` and ``file_row``: sorted by the two, they are in the written order."""
    return spark.read.parquet(path).select("*", "_metadata.file_name", F.col("_metadata.row_index").alias("file_row"))


def refresh_office(df: DataFrame, path: str, office: str, column: str = "NURAC") -> None:
    """Replace one office's rows of a report kept at ``path``, one folder per office; other folders are not touched.

    ``df`` is the dimension of that office. Rows of another office raise, before anything is replaced. An
    office without rows loses its folder: Spark replaces only folders that it writes to.
    """
    name = F.col(f"`{column}`")
    other = F.when(~name.eqNullSafe(F.lit(office)), F.raise_error(F.concat(F.lit("row of another office: "), F.coalesce(name.cast("string"), F.lit("NULL")))))
    rows = Observation("rows of the office")
    own = df.withColumn(column, F.coalesce(other.cast("string"), name)).observe(rows, F.count(F.lit(1)).alias("n"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    if not rows.get["n"]:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, office)
        remove_path(df.sparkSession, f"{path.rstrip('/')}/{folder}")
