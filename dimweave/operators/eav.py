"""Entity-attribute-value lookups: the rows of some attributes, and the three per-demand picks.

The row set is ``demanda_dado`` (demand, value id, time) joined to ``dado_valor`` (value id,
attribute id, text) and filtered on attribute ids; the filter is pushed to the scan of the
table that holds ``id_dado``. The picks are the per-attribute plan (one window per
attribute); the single-pass plan in ``dimweave.operators.pivot`` computes all of them in one
aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimweave.functions.dates import strict_date
from dimweave.operators.topk import desc_nulls_first, top1_per_key
from dimweave.sources.tables import DemandTables

ROW_COLUMNS = ("id_demanda", "id_dado", "id_dado_valor", "dt_cadastro", "nm_valor")


def id_filter(ids: Iterable) -> Column:
    ids = list(dict.fromkeys(ids))
    return F.col("id_dado") == F.lit(ids[0]) if len(ids) == 1 else F.col("id_dado").isin(ids)


def spine(tables: DemandTables, version=None) -> DataFrame:
    """Demands of one process version (all demands when ``version`` is None)."""
    d = tables.demanda
    return d if version is None else d.where(F.col("id_versao_processo") == F.lit(version))


def eav_rows(tables: DemandTables, ids: Iterable, demands: DataFrame | None = None) -> DataFrame:
    """Value rows of the attributes ``ids``: id_demanda, id_dado, id_dado_valor, dt_cadastro, nm_valor.

    With ``demands`` only rows of those demands are kept (a left-semi join, so a demand listed
    twice does not double its rows). The bridge is reduced to them first, so rows of other demands never
    reach the shuffle by value id; where there is no such shuffle (tables bucketed alike), the values come first.
    """
    hit = id_filter(ids)
    if tables.id_dado_on_bridge:
        bridge = tables.demanda_dado.where(hit).select("id_demanda", "id_dado_valor", "dt_cadastro", "id_dado")
        value = tables.dado_valor.select("id_dado_valor", "nm_valor")
    else:
        bridge = tables.demanda_dado.select("id_demanda", "id_dado_valor", "dt_cadastro")
        value = tables.dado_valor.where(hit).select("id_dado_valor", "id_dado", "nm_valor")
    if demands is None:
        return bridge.join(value, "id_dado_valor").select(*ROW_COLUMNS)
    wanted = demands.select("id_demanda")
    if tables.values_beside_bridge:
        # an inner join: Spark would push a semi-join below the bucketed one
        rows = bridge.join(value, "id_dado_valor").join(wanted.distinct(), "id_demanda")
    else:
        rows = bridge.join(wanted, "id_demanda", "left_semi").join(value, "id_dado_valor")
    return rows.select(*ROW_COLUMNS)


def latest_order() -> list[Column]:
    """Newest bridge time first, a NULL time before any time, then the newest value id."""
    return [desc_nulls_first("dt_cadastro"), F.col("id_dado_valor").desc()]


def pick_latest(rows: DataFrame, out: str) -> DataFrame:
    """One row per demand: the value of its newest row (see ``latest_order``)."""
    return top1_per_key(rows, "id_demanda", latest_order()).select("id_demanda", F.col("nm_valor").alias(out))


def pick_all(rows: DataFrame, out: str, distinct: bool = False) -> DataFrame:
    """Every value row of the demand (multi-valued attributes fan the result out).

    ``distinct`` folds exact copies first. Under a final DISTINCT the result is the same, and
    joining several multi-valued attributes then multiplies distinct values, not rows.
    """
    vals = rows.select("id_demanda", F.col("nm_valor").alias(out))
    return vals.distinct() if distinct else vals


def pick_max_date(rows: DataFrame, out: str, date_formats: tuple = ()) -> DataFrame:
    """The greatest value read as a date, a NULL date first; rows tied for first are all kept."""
    dated = rows.select("id_demanda", strict_date("nm_valor", date_formats).alias(out))
    return top1_per_key(dated, "id_demanda", [desc_nulls_first(out)], ties=True)
