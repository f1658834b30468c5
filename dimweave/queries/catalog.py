"""Registered queries over the testdata: each takes (spark, sf_dir) and returns a DataFrame.

Each exercises operators of the demand dimension on the surrogate workflow tables
(``dimweave.sources.surrogate``) over whole tables; ``dimweave.queries.oracle`` holds the
equivalent DuckDB SQL, with the same column names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dimweave.config import CAPTURE_DEFAULT, CAPTURE_LABEL, STAGE_DEFAULT
from dimweave.functions.dates import business_days, close_interval, month_name, strict_date, to_day
from dimweave.functions.text import executor_label, place_label, strict_int, substr
from dimweave.operators.eav import eav_rows, latest_order, pick_all, pick_latest, pick_max_date, spine
from dimweave.operators.fanout import fan_out
from dimweave.operators.incremental import read_state, update_state, write_state
from dimweave.operators.joins import gated_left_chain, join_flag
from dimweave.operators.pivot import latest_values, scalar_picks
from dimweave.operators.stages import current_stage, existence_flag, role_join
from dimweave.operators.topk import desc_nulls_first, top1_per_key
from dimweave.plans.checks import bad_values
from dimweave.plans.dimension import REPORT_COLUMNS, demand_dimension, planned_business_days, write_attributes
from dimweave.session import checkpoint_dir
from dimweave.sources import surrogate as S
from dimweave.sources.buckets import load_bucketed, save_bucketed
from dimweave.sources.sinks import read_in_order, refresh_office, write_ordered, write_parquet

CFG = S.SURROGATE_CONFIG
V = S.SURROGATE_VERSION


def _t(spark, sf_dir):
    return S.surrogate_tables(spark, sf_dir)


def _ids(*roles):
    return [i for r in roles for i in CFG.attributes[r].ids]


def _rows(t, *roles, version=V):
    return eav_rows(t, _ids(*roles), spine(t, version))


def q01_eav_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All execution dates of the version's demands (demand, bridge, value; version and id filters)."""
    t = _t(spark, sf_dir)
    return _rows(t, "data_exec").select("id_demanda", "id_dado_valor", "dt_cadastro", "nm_valor")


def q02_latest_value(spark, sf_dir):
    """Newest execution-date row per demand: NULL time first, then newest time, then newest value id."""
    t = _t(spark, sf_dir)
    rows = eav_rows(t, _ids("data_exec"))
    return top1_per_key(rows, "id_demanda", latest_order()).select(
        "id_demanda", "id_dado_valor", "dt_cadastro", "nm_valor"
    )


def q03_multi_attribute(spark, sf_dir):
    """Every value of a list of attribute ids (IN list), per demand of the version."""
    t = _t(spark, sf_dir)
    return _rows(t, "tp_insp").select("id_demanda", "id_dado", "nm_valor")


def q04_current_stage(spark, sf_dir):
    """Newest order per customer as its current stage: first-match label, executor relabel."""
    t = _t(spark, sf_dir)
    orders = S.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_demanda_etapa"),
        F.col("o_custkey").alias("id_demanda"),
        S.executor_login().alias("nm_login_executor"),
        F.col("o_orderpriority").alias("nm_elemento_pn"),
    )
    cur = current_stage(orders, S.PRIORITY_STAGE_RULES, STAGE_DEFAULT)
    status = t.demanda.select("id_demanda", "id_status_demanda").join(
        t.status_demanda, "id_status_demanda"
    )
    return cur.join(status, "id_demanda").select(
        "id_demanda",
        "id_demanda_etapa",
        "etapa",
        executor_label(
            "nm_login_executor", "nm_status_demanda", S.SURROGATE_COMPLETED, CFG.finished_executor, CFG.no_executor
        ).alias("executor_atual"),
    )


def q05_max_date_ties(spark, sf_dir):
    """Greatest planned start per demand of the version, NULL first, tied rows all kept."""
    t = _t(spark, sf_dir)
    return pick_max_date(_rows(t, "ini_prev"), "dia")


def q06_role_playing(spark, sf_dir):
    """Stage log with the element table in two roles: origin (of the version) and destination."""
    t = _t(spark, sf_dir)
    origin = t.elemento_pn.where(F.col("id_versao_processo") == S.SURROGATE_ELEMENT_VERSION)
    out = role_join(
        t.demanda_etapa, origin, "id_elemento_pn_inicial", "id_elemento_pn", {"nm_elemento_pn": "origem"}
    )
    out = role_join(out, t.elemento_pn, "id_elemento_pn_passagem", "id_elemento_pn", {"nm_elemento_pn": "destino"})
    return out.select("id_demanda_etapa", "id_demanda", "origem", "destino")


def q07_existence_flag(spark, sf_dir):
    """Demands of the version flagged when a stage moved between two elements, else a default."""
    t = _t(spark, sf_dir)
    flags = existence_flag(t, *S.SURROGATE_CAPTURE, CAPTURE_LABEL, S.SURROGATE_ELEMENT_VERSION)
    base = spine(t, V).select("id_demanda")
    return join_flag(base, flags, "sit", CAPTURE_DEFAULT).select("id_demanda", F.col("sit").alias("situacao"))


def q08_gated_place(spark, sf_dir):
    """Place label from latest municipality, state and aerodrome;
    state and aerodrome only through a municipality row."""
    t = _t(spark, sf_dir)
    mun = pick_latest(_rows(t, "municipio"), "municipio")
    uf = pick_latest(_rows(t, "uf"), "uf")
    aero = pick_latest(_rows(t, "aerodromo"), "aerodromo")
    return gated_left_chain(mun, uf, aero).select(
        "id_demanda", place_label("municipio", "uf").alias("local_execucao"), "aerodromo"
    )


def _office(spark, sf_dir):
    t = _t(spark, sf_dir)
    demands = spine(t, None).select("id_demanda")
    office = pick_latest(eav_rows(t, _ids("nurac"), demands), "nurac")
    return demands.join(office, "id_demanda", "left")


def q09_null_rejecting(spark, sf_dir):
    """Latest office left-joined, then filtered to one office (the filter acts after the pick)."""
    return _office(spark, sf_dir).where(F.col("nurac") == CFG.office)


def q10_default_when_unfiltered(spark, sf_dir):
    """Latest office left-joined without the filter; a demand without one reads 'N.D.'."""
    return _office(spark, sf_dir).select(
        "id_demanda", F.when(F.col("nurac").isNull(), F.lit(CFG.office_missing)).otherwise(F.col("nurac")).alias("nurac")
    )


def q11_substring_int(spark, sf_dir):
    """Brand number: 1-based substring then strict integer cast."""
    part = S.read(spark, sf_dir, "part")
    return part.select("p_partkey", strict_int(substr("p_brand", 7, 2)).alias("brand_no"))


def q12_ts_to_date_year(spark, sf_dir):
    """Stage start day, and year closed falling back to the year started."""
    t = _t(spark, sf_dir)
    return t.demanda_etapa.select(
        "id_demanda_etapa",
        to_day("dt_inicio").alias("dia_inicio"),
        F.coalesce(F.year("dt_fim"), F.year("dt_inicio")).alias("ano"),
    )


def q13_month_name(spark, sf_dir):
    """Planned month (name of the greatest planned date, else a text attribute) and realized
    month (name of each execution date, only for completed demands)."""
    t = _t(spark, sf_dir)
    base = spine(t, V).select("id_demanda", "id_status_demanda").join(
        t.status_demanda, "id_status_demanda"
    )
    term = pick_max_date(_rows(t, "term_prev"), "term_prev").distinct()
    mes = pick_latest(_rows(t, "mes_prev"), "mes_prev")
    ex = pick_all(_rows(t, "data_exec"), "data_exec", distinct=True).withColumn("data_exec", strict_date("data_exec"))
    df = base.join(term, "id_demanda", "left").join(mes, "id_demanda", "left").join(ex, "id_demanda", "left")
    return df.select(
        "id_demanda",
        F.when(F.col("term_prev").isNotNull(), month_name("term_prev", CFG.month_names))
        .otherwise(substr("mes_prev", 6, 10))
        .alias("mes_previsto"),
        F.when(F.col("nm_status_demanda") == S.SURROGATE_COMPLETED, month_name("data_exec", CFG.month_names)).alias(
            "mes_realizado"
        ),
    ).distinct()


def q14_business_days(spark, sf_dir):
    """Business days of each stage (both ends counted, weekday holidays off); 1 while open."""
    t = _t(spark, sf_dir)
    return t.demanda_etapa.select(
        "id_demanda_etapa",
        F.when(F.col("dt_fim").isNull(), F.lit(1))
        .otherwise(business_days("dt_inicio", "dt_fim", S.SURROGATE_HOLIDAYS))
        .alias("dias_uteis"),
    )


def q15_close_interval(spark, sf_dir):
    """Stage end, the fixed as-of instant while open."""
    t = _t(spark, sf_dir)
    return t.demanda_etapa.select("id_demanda_etapa", close_interval("dt_fim", S.SURROGATE_AS_OF).alias("data_fim"))


def q16_distinct_fanout(spark, sf_dir):
    """Two multi-valued attributes joined to the demand (each combination once)."""
    return _two_roles(spark, sf_dir, CFG.fanout_rows_per_task, CFG.fanout_block)


def _two_roles(spark, sf_dir, rows_per_task, block):
    t = _t(spark, sf_dir)
    nup = pick_all(_rows(t, "nup"), "nup")
    ano = pick_all(_rows(t, "ano_prev"), "ano_prev").withColumn("ano_prev", strict_int("ano_prev"))
    roles = [("nup", nup), ("ano_prev", ano)]
    return fan_out(spine(t, V).select("id_demanda"), roles, rows_per_task, ["ano_prev"], block=block).drop("cell", "place")


def q17_single_pass(spark, sf_dir):
    """Six latest values and one greatest date per demand from one aggregation over one scan."""
    t = _t(spark, sf_dir)
    attrs = {n: CFG.attributes[n] for n in ("situacao", "nurac", "mes_prev", "municipio", "uf", "aerodromo", "ini_prev")}
    return scalar_picks(latest_values(_rows(t, *attrs)), attrs, demands=spine(t, V).select("id_demanda"))


def q18_last_turn(spark, sf_dir):
    """Last turn of each conversation (rank by turn, ties kept), whole text."""
    conv = S.read(spark, sf_dir, "conversations")
    return top1_per_key(conv, "conv_id", [desc_nulls_first("turn")], ties=True).select("conv_id", "turn", "role", "text")


def q19_star_sorted(spark, sf_dir):
    """Reduced star: demand, status, latest situation and office, report names, sorted."""
    t = _t(spark, sf_dir)
    base = spine(t, V).join(t.status_demanda, "id_status_demanda")
    sit = pick_latest(_rows(t, "situacao"), "situacao")
    office = pick_latest(_rows(t, "nurac"), "nurac")
    df = base.join(sit, "id_demanda").join(office, "id_demanda", "left")
    return df.select(
        F.col("id_demanda").alias(REPORT_COLUMNS[0]),
        to_day("dt_cadastro").alias(REPORT_COLUMNS[1]),
        F.col("situacao").alias(REPORT_COLUMNS[8]),
        F.col("nm_login_cadastrador").alias(REPORT_COLUMNS[9]),
        F.coalesce(F.col("nurac"), F.lit(CFG.office_missing)).alias(REPORT_COLUMNS[10]),
        F.col("nm_status_demanda").alias(REPORT_COLUMNS[11]),
    ).orderBy(REPORT_COLUMNS[0])


def q20_demand_dimension(spark, sf_dir):
    """The whole demand dimension on the surrogate tables (single-pass plan over the written attributes)."""
    t = _t(spark, sf_dir)
    return demand_dimension(t, CFG, plan="single_pass", values=write_attributes(t, CFG).df)


def q21_dimension_per_attribute(spark, sf_dir):
    """The same dimension by the per-attribute plan (one lookup and join per attribute)."""
    return demand_dimension(_t(spark, sf_dir), CFG, plan="per_attribute")


def q22_planned_business_days(spark, sf_dir):
    """Business days from the greatest planned start to the greatest planned end date per
    demand of the version; 1 without a planned end."""
    return planned_business_days(_t(spark, sf_dir), CFG)


def q23_split_fanout(spark, sf_dir):
    """The rows of q16, with every demand cut into blocks of values and stretches of two rows."""
    return _two_roles(spark, sf_dir, rows_per_task=2, block=1)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/dimweave/{name}-{uuid.uuid4().hex}"


def q24_incremental_latest(spark, sf_dir):
    """Latest values kept as a state: two thirds of the rows folded and stored, the last third merged in."""
    t = _t(spark, sf_dir)
    rows = eav_rows(t, _ids(*CFG.attributes), spine(t, V))
    late = F.col("id_dado_valor") % 3 == 0
    path = _scratch(spark, "state")
    write_state(latest_values(rows.where(~late)), path)
    new = latest_values(rows.where(late))
    update_state(path, new)
    state = read_state(spark, path, new)
    return state.select("id_demanda", "id_dado", "nm_valor", F.col("newest.t").alias("dt_cadastro"), F.col("newest.i").alias("id_dado_valor"))


def q25_bucketed_lookup(spark, sf_dir):
    """The rows of q01 from bucketed tables: bridge and values are joined bucket by bucket, without a shuffle."""
    name = f"dimweave_{uuid.uuid4().hex}"
    save_bucketed(_t(spark, sf_dir), name, 8, _scratch(spark, "buckets"))
    return _rows(load_bucketed(spark, name), "data_exec").select("id_demanda", "id_dado_valor", "dt_cadastro", "nm_valor")


def q26_office_refresh(spark, sf_dir):
    """The report of all offices, kept in a folder each, after one office was computed alone and replaced."""
    t = _t(spark, sf_dir)
    path = _scratch(spark, "report")
    with write_attributes(t, CFG.with_(office=None)) as values:
        write_parquet(demand_dimension(t, CFG.with_(office=None), sort=False, values=values), path, partition_by="NURAC")
        refresh_office(demand_dimension(t, CFG, sort=False, values=values), path, CFG.office)
    return spark.read.parquet(path).select(*REPORT_COLUMNS)


def q27_ordered_files(spark, sf_dir):
    """The reduced star written in report order; every row with its place when the files are read by name."""
    path = _scratch(spark, "ordered")
    write_ordered(q19_star_sorted(spark, sf_dir), path, [REPORT_COLUMNS[0]], files=4, rows_per_file=100)
    rows = read_in_order(spark, path)
    before = Window.orderBy("file_name")
    counts = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))  # one row a file
    starts = counts.select("file_name", (F.sum("n").over(before) - F.col("n")).alias("start"))
    return rows.join(starts, "file_name").select((F.col("start") + F.col("file_row") + 1).alias("place"), F.col(REPORT_COLUMNS[0]).alias("id_demanda"))


def q28_bad_values(spark, sf_dir):
    """Texts that their role could not read if year and execution date were kept in the process number's attributes."""
    t = _t(spark, sf_dir)
    return bad_values(_rows(t, "nup", "ano_prev", "data_exec"), CFG.with_(attributes=S.MISREAD_ATTRIBUTES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q01_eav_lookup,
        q02_latest_value,
        q03_multi_attribute,
        q04_current_stage,
        q05_max_date_ties,
        q06_role_playing,
        q07_existence_flag,
        q08_gated_place,
        q09_null_rejecting,
        q10_default_when_unfiltered,
        q11_substring_int,
        q12_ts_to_date_year,
        q13_month_name,
        q14_business_days,
        q15_close_interval,
        q16_distinct_fanout,
        q17_single_pass,
        q18_last_turn,
        q19_star_sorted,
        q20_demand_dimension,
        q21_dimension_per_attribute,
        q22_planned_business_days,
        q23_split_fanout,
        q24_incremental_latest,
        q25_bucketed_lookup,
        q26_office_refresh,
        q27_ordered_files,
        q28_bad_values,
    )
}
