"""A kept table of attribute values that new rows are merged into, without reading the old rows again.

``latest_values`` folds attribute rows to one per (demand, attribute, value) with the greatest (time is
NULL, time, value id). The greatest of a union is the greatest of the parts' greatest ones, so the folded
table is a state: fold the new rows alone, and fold the two folded tables once more. It is kept as Parquet,
partitioned by attribute; an update reads and rewrites only the attributes that have new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimweave.operators.materialize import write_shared

STATE_KEYS = ("id_demanda", "id_dado", "nm_valor")


def merge_latest(*states: DataFrame) -> DataFrame:
    """The state of all rows from the states of parts of them, in any order and grouping."""
    both = states[0].select(*STATE_KEYS, "newest")
    for other in states[1:]:
        both = both.unionByName(other.select(*STATE_KEYS, "newest"))
    return both.groupBy(*STATE_KEYS).agg(F.max("newest").alias("newest"))


def write_state(state: DataFrame, path: str) -> None:
    """Start a kept state at ``path`` (which must not exist)."""
    state.select(*STATE_KEYS, "newest").hint("rebalance", "id_dado").write.partitionBy("id_dado").parquet(path)


def read_state(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The kept state; ``like`` is any state table, whose column types are used."""
    schema = like.select(*STATE_KEYS, "newest").schema
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def update_state(path: str, new: DataFrame) -> list:
    """Merge the state ``new`` of some new rows into the kept one; returns the ids of the attributes rewritten.

    The merged attributes are written beside the state first and then replace their folders, so a failure
    before that leaves the kept state as it was, and running the update again gives the same state (merging
    rows twice changes nothing). The ids are collected: there are as many as attributes.
    """
    spark = new.sparkSession
    with write_shared(new.select(*STATE_KEYS, "newest"), "new-values", partition_by="id_dado") as fresh:
        touched = sorted(r[0] for r in fresh.select("id_dado").distinct().collect())
        if not touched:
            return []
        kept = read_state(spark, path, fresh).where(F.col("id_dado").isin(touched))
        with write_shared(merge_latest(kept, fresh), "merged-values", partition_by="id_dado") as merged:
            writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("id_dado").parquet(path)
    return touched
