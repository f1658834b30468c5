"""Join shapes of the dimension that are more than one ``join`` call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gated_left_chain(gate: DataFrame, *others: DataFrame, key: str = "id_demanda") -> DataFrame:
    """``gate`` LEFT JOIN each of ``others`` on ``key``: rows of ``others`` survive only for
    keys present in ``gate`` (a state or aerodrome without a municipality row is lost)."""
    out = gate
    for o in others:
        out = out.join(o, key, "left")
    return out


def gated(value, present) -> F.Column:
    """The single-pass form of the gate: ``value`` where the gate row exists, else NULL."""
    v = F.col(value) if isinstance(value, str) else value
    p = F.col(present) if isinstance(present, str) else present
    return F.when(p.isNotNull(), v)


def join_flag(df: DataFrame, flags: DataFrame, flag_col: str, default, key: str = "id_demanda") -> DataFrame:
    """Left-join a distinct flag table and default the flag where absent."""
    return df.join(flags, key, "left").withColumn(flag_col, F.coalesce(F.col(flag_col), F.lit(default)))


def with_null_rows(values: DataFrame, lacking: DataFrame) -> DataFrame:
    """``values`` plus one row with NULLs for each demand of ``lacking`` (demands without a value).

    The inner join with the result is then the LEFT JOIN with ``values``.
    """
    return values.unionByName(lacking.select("id_demanda"), allowMissingColumns=True)
