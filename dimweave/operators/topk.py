"""Top-1 row per key: the latest-row and newest-stage picks.

Both are ``rank``/``row_number`` = 1 over a window, which Spark plans as a
``WindowGroupLimit``: each map task keeps only its own top rows per key before the shuffle, so
a key holding a third of all rows ships a handful of rows, not its whole group, to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc_nulls_first(c) -> Column:
    """Descending order with NULL first (the PostgreSQL default for DESC)."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def top1_per_key(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column],
    ties: bool = False,
) -> DataFrame:
    """Rows ranked first per ``keys`` by ``order``.

    ``ties=False`` keeps exactly one row per key (``row_number``), so ``order`` must end in a
    unique tiebreaker for the pick to be deterministic. ``ties=True`` keeps every row that
    shares the first place (``rank``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    fn = F.rank() if ties else F.row_number()
    return df.withColumn("__rank", fn.over(w)).where(F.col("__rank") == 1).drop("__rank")
