"""The attribute tables laid out so that bridge and values meet without a shuffle.

``demanda_dado`` and ``dado_valor`` are bucketed and sorted by ``id_dado_valor``, in the same number of
buckets: Spark then joins bucket with bucket where they are read (no exchange below the join). The table
that holds ``id_dado`` is also partitioned by it, so an attribute filter reads only the folders of its ids.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from dimweave.sources.schemas import TABLES
from dimweave.sources.tables import DemandTables

_BUCKETED = ("demanda_dado", "dado_valor")


def save_bucketed(tables: DemandTables, database: str, buckets: int, location: str | None = None) -> None:
    """Write the six tables to the catalog database ``database`` (made at ``location`` if it is new)."""
    spark = tables.demanda.sparkSession
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    for name in TABLES:
        df = getattr(tables, name)
        if name in _BUCKETED:
            # one task a bucket, so a bucket is one file per attribute
            writer = df.repartition(buckets, "id_dado_valor").write.bucketBy(buckets, "id_dado_valor").sortBy("id_dado_valor")
            if "id_dado" in df.columns:
                writer = writer.partitionBy("id_dado")
        else:
            writer = df.write
        writer.mode("overwrite").saveAsTable(f"{database}.{name}")


def load_bucketed(spark: SparkSession, database: str) -> DemandTables:
    """The tables ``save_bucketed`` wrote; lookups join bridge and values first, where they lie."""
    return DemandTables(**{name: spark.table(f"{database}.{name}") for name in TABLES}, values_beside_bridge=True)
