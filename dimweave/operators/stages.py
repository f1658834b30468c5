"""Stage-log operators: the current stage of each demand, existence flags, role-playing joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.functions.dates import close_interval
from dimweave.functions.text import first_match_label
from dimweave.operators.topk import desc_nulls_first, top1_per_key
from dimweave.sources.tables import DemandTables


def stage_log(tables: DemandTables, element_version=None) -> DataFrame:
    """Stages whose starting element belongs to ``element_version``, with the element's name.

    The version test acts before any ranking, so a newer stage of another version never hides
    this version's newest stage. Spark broadcasts the element dimension when its bytes are few.
    """
    el = tables.elemento_pn
    if element_version is not None:
        el = el.where(F.col("id_versao_processo") == F.lit(element_version))
    el = el.select("id_elemento_pn", "nm_elemento_pn")
    et = tables.demanda_etapa
    return et.join(el, et["id_elemento_pn_inicial"] == el["id_elemento_pn"]).drop("id_elemento_pn")


def current_stage(
    stages: DataFrame,
    rules,
    default: str,
    as_of: dt.datetime | None = None,
    key: str = "id_demanda",
    order_col: str = "id_demanda_etapa",
    name_col: str = "nm_elemento_pn",
) -> DataFrame:
    """Newest stage per demand (highest stage id; ties all kept), its label and closed end.

    Output: the stage columns plus ``data_fim`` (``dt_fim``, or ``as_of`` while open) and
    ``etapa`` (first matching pattern of ``rules``, else ``default``).
    """
    newest = top1_per_key(stages, key, [desc_nulls_first(order_col)], ties=True)
    cols = [c for c in newest.columns if c not in ("dt_fim", name_col)]
    extra = []
    if "dt_fim" in newest.columns:
        extra.append(close_interval("dt_fim", as_of).alias("data_fim"))
    extra.append(first_match_label(name_col, rules, default).alias("etapa"))
    return newest.select(*cols, *extra)


def existence_flag(
    tables: DemandTables,
    from_element,
    to_element,
    label: str,
    element_version=None,
    flag_col: str = "sit",
) -> DataFrame:
    """Distinct demands with a stage moving ``from_element`` -> ``to_element``, flagged ``label``.

    The origin element must belong to ``element_version`` and the destination must exist in
    the element table (the two roles of one dimension). Left-join the result and default the
    flag with ``coalesce``; being distinct, the join cannot multiply rows.
    """
    el = tables.elemento_pn
    origin = el.where(F.col("id_elemento_pn") == F.lit(from_element))
    if element_version is not None:
        origin = origin.where(F.col("id_versao_processo") == F.lit(element_version))
    origin = origin.select(F.col("id_elemento_pn").alias("id_elemento_pn_inicial"))
    dest = el.where(F.col("id_elemento_pn") == F.lit(to_element)).select(
        F.col("id_elemento_pn").alias("id_elemento_pn_passagem")
    )
    moves = tables.demanda_etapa.where(
        (F.col("id_elemento_pn_inicial") == F.lit(from_element)) & (F.col("id_elemento_pn_passagem") == F.lit(to_element))
    )
    hits = moves.join(origin, "id_elemento_pn_inicial", "left_semi").join(dest, "id_elemento_pn_passagem", "left_semi")
    return hits.select("id_demanda").distinct().withColumn(flag_col, F.lit(label))


def stages_and_flag(
    tables: DemandTables,
    element_version,
    rules,
    default: str,
    from_element,
    to_element,
    label: str,
    demands: DataFrame | None = None,
    flag_col: str = "sit",
) -> DataFrame:
    """``current_stage`` and ``existence_flag`` in one read of the stage log: id_demanda, nm_login_executor, etapa, <flag_col>.

    A stage counts as a candidate for the newest one and, if it moves ``from_element`` -> ``to_element``,
    for the flag. The first of each (demand, purpose) is kept by one window, whose group limit acts before
    the shuffle: a hot demand ships its newest stages, not its log. Stages tied for the newest all stay
    (with one login and label they are one row); a demand without a stage has no row.
    """
    el = tables.elemento_pn
    origin = el if element_version is None else el.where(F.col("id_versao_processo") == F.lit(element_version))
    origin = origin.select(F.col("id_elemento_pn").alias("id_elemento_pn_inicial"), "nm_elemento_pn")
    known = el.where(F.col("id_elemento_pn") == F.lit(to_element)).select(
        F.col("id_elemento_pn").alias("id_elemento_pn_passagem"), F.lit(True).alias("known")
    ).distinct()
    log = tables.demanda_etapa.select("id_demanda_etapa", "id_demanda", "nm_login_executor", "id_elemento_pn_inicial", "id_elemento_pn_passagem")
    if demands is not None:
        log = log.join(demands.select("id_demanda"), "id_demanda", "left_semi")
    moves = (F.col("id_elemento_pn_inicial") == F.lit(from_element)) & (F.col("id_elemento_pn_passagem") == F.lit(to_element)) & F.col("known")
    log = log.join(origin, "id_elemento_pn_inicial").join(known, "id_elemento_pn_passagem", "left")
    purposes = F.explode(F.when(moves, F.array(F.lit("newest"), F.lit("flag"))).otherwise(F.array(F.lit("newest"))))
    log = log.select("id_demanda", "id_demanda_etapa", "nm_login_executor", "nm_elemento_pn", purposes.alias("purpose"))
    first = top1_per_key(log, ["id_demanda", "purpose"], [desc_nulls_first("id_demanda_etapa")], ties=True)
    newest = F.when(F.col("purpose") == "newest", F.struct("nm_login_executor", first_match_label("nm_elemento_pn", rules, default).alias("etapa")))
    held = first.groupBy("id_demanda").agg(F.collect_set(newest).alias("newest"), F.bool_or(F.col("purpose") == "flag").alias("flagged"))
    return held.select("id_demanda", F.explode("newest").alias("stage"), F.when(F.col("flagged"), F.lit(label)).alias(flag_col)).select(
        "id_demanda", "stage.*", flag_col
    )


def role_join(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    dim_key: str,
    columns: dict[str, str],
    how: str = "inner",
) -> DataFrame:
    """Join one role of a dimension: ``df[on] == dim[dim_key]``, bringing ``columns``
    (dimension column -> output name). Call once per role to play a dimension twice."""
    d = dim.select(F.col(dim_key).alias(f"__{on}_key"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(d, df[on] == d[f"__{on}_key"], how).drop(f"__{on}_key")
