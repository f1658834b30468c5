"""Single-pass attribute picks: every attribute of every demand from one read of the EAV tables.

``latest_values`` folds the attribute rows of the kept demands to one row per (demand, attribute,
value) with its newest time and value id. Spark folds partially in each map task, so a demand with a
third of all rows sends its distinct values, not its rows. Everything else reads that table: scalar
picks are one ``groupBy('id_demanda')``, the multi-valued roles' lists one grouping by demand and cell.

Value text is parsed only inside ``CASE WHEN id_dado IN (...)`` of the attribute that owns it, so a
strict cast never sees another attribute's text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimweave.config import ALL, LATEST, MAX_DATE, Attribute
from dimweave.functions.dates import strict_date
from dimweave.operators.eav import id_filter


def latest_values(rows: DataFrame) -> DataFrame:
    """id_demanda, id_dado, nm_valor, newest: one row per value, with the greatest (time is NULL, time, value id).

    In this order a NULL time wins, then the newest time, then the newest value id.
    """
    dt = F.col("dt_cadastro")
    newest = F.max(F.struct(dt.isNull().alias("n"), dt.alias("t"), F.col("id_dado_valor").alias("i")))
    return rows.groupBy("id_demanda", "id_dado", "nm_valor").agg(newest.alias("newest"))


def latest_pick(hit) -> Column:
    """Aggregate over ``latest_values`` rows: the newest text among the rows where ``hit`` holds."""
    return F.max_by(F.col("nm_valor"), F.when(hit, F.col("newest")))


def scalar_picks(
    values: DataFrame,
    attributes: Mapping[str, Attribute],
    presence: Iterable[tuple[str, Attribute]] = (),
    date_formats: tuple = (),
    demands: DataFrame | None = None,
) -> DataFrame:
    """One row per demand with a column per LATEST / MAX_DATE attribute and a ``has_<name>``
    column (True, or NULL when the demand has no row of it) for each (name, attribute) of ``presence``.

    ``values`` is ``latest_values`` of the kept demands' rows: a text that is not a date fails the
    query. With ``demands`` the picks are left-joined to it (every demand gets a row, with all its
    columns).
    """
    aggs = []
    for name, attr in attributes.items():
        hit = id_filter(attr.ids)
        if attr.pick == LATEST:
            aggs.append(latest_pick(hit).alias(name))
        elif attr.pick == MAX_DATE:
            d = F.when(hit, strict_date("nm_valor", date_formats))
            # a NULL date outranks every date (descending, NULL first); equal dates are one value
            aggs.append(F.max_by(d, F.when(hit, F.struct(d.isNull().alias("n"), d.alias("d")))).alias(name))
        else:
            raise ValueError(f"{name}: pick {attr.pick!r} is not scalar")
    for name, attr in presence:
        aggs.append(F.max(F.when(id_filter(attr.ids), F.lit(True))).alias(f"has_{name}"))
    picks = values.groupBy("id_demanda").agg(*aggs)
    return picks if demands is None else demands.join(picks, "id_demanda", "left")


__all__ = ["ALL", "LATEST", "MAX_DATE", "id_filter", "latest_pick", "latest_values", "scalar_picks"]
