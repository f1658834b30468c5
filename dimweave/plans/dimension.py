"""The demand dimension: one row per demand and combination of its multi-valued attributes.

Two plans compute the same rows:

``single_pass`` (default)
    The kept demands come first: those of the version whose latest office is the wanted one. Spine, attribute
    rows and stage log are reduced to them before anything is folded or shuffled by demand. The attribute
    rows are folded to one per (demand, attribute, value); latest values, greatest dates, presence and the
    multi-valued roles all read that table. ``write_attributes`` writes it, explicitly, for a large job;
    without a written store the plan is the same and lazy, but its branches may read the sources again.

``per_attribute``
    One EAV lookup, window pick and join per attribute, the shape of the original job, its fan-out not
    split. It is kept to check the single pass against and to compare plans, not for large demands.

Assembly of the single pass: kept demands -> status -> scalar attributes -> required-attribute filter ->
current stage and capture flag (one read of the log) -> plain report columns -> product with the roles'
values, distinct as it is built. No shuffle but the final sort carries the whole report. Building a
dimension runs no job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimweave.config import ALL, LATEST, MAX_DATE, DimensionConfig
from dimweave.functions.dates import business_days, month_name, strict_date, to_day
from dimweave.functions.text import executor_label, place_label, strict_int, substr
from dimweave.operators.eav import eav_rows, pick_all, pick_latest, pick_max_date, spine
from dimweave.operators.fanout import member_rows, product, value_column
from dimweave.operators.joins import gated, gated_left_chain
from dimweave.operators.materialize import Stored, write_shared
from dimweave.operators.pivot import id_filter, latest_pick, latest_values, scalar_picks
from dimweave.operators.stages import current_stage, existence_flag, stage_log, stages_and_flag
from dimweave.plans.checks import BadAttributeValues, observed, raise_if_bad
from dimweave.sources.tables import DemandTables

PLANS = ("single_pass", "per_attribute")

# The report's column names, in the report's order.
REPORT_COLUMNS = (
    "Nº Demanda",
    "Data de Cadastro",
    "Nº Processo",
    "Ano do Processo",
    "Gerência",
    "Superintendência",
    "Tipo de Inspeção",
    "Linha PTA (SPO)",
    "Situação da Demanda",
    "Solicitante",
    "NURAC",
    "Status da Demanda",
    "Ano Previsto",
    "Mês de Execução Previsto",
    "Mês de Execução Realizado",
    "Local de Execução",
    "Aeródromo",
    "Etapa",
    "Executor Atual",
    "Situação",
    "Data de Início Prevista",
    "Data de Término Prevista",
    "Data de Execução",
)

# Roles read only through the municipality row (the gated place chain).
_GATED = ("uf", "aerodromo")


def _registry_ids(cfg: DimensionConfig) -> list:
    return list(dict.fromkeys(i for a in cfg.attributes.values() for i in a.ids))


def _base(tables: DemandTables, cfg: DimensionConfig, kept: DataFrame | None = None) -> DataFrame:
    demands = spine(tables, cfg.version).select("id_demanda", "id_status_demanda", "dt_cadastro", "nm_login_cadastrador")
    if kept is not None:
        demands = demands.join(kept, "id_demanda", "left_semi")
    status = tables.status_demanda.select("id_status_demanda", "nm_status_demanda")
    return demands.join(status, "id_status_demanda")


def kept_demands(tables: DemandTables, cfg: DimensionConfig, values: DataFrame | None = None) -> DataFrame:
    """id_demanda of the version's demands whose latest office is ``cfg.office`` (all of the version without one).

    The office is compared after the latest pick, so a demand that has moved to another office is not kept.
    Only the office attribute's rows are read (of the tables, or of the written ``values``), and every other
    input is reduced to these demands before it is shuffled.
    """
    demands = spine(tables, cfg.version).select("id_demanda")
    if cfg.office is None:
        return demands
    ids = cfg.attributes["nurac"].ids
    rows = latest_values(eav_rows(tables, ids, demands)) if values is None else values.where(id_filter(ids))
    office = rows.groupBy("id_demanda").agg(latest_pick(F.lit(True)).alias("nurac"))
    return office.where(F.col("nurac") == F.lit(cfg.office)).select("id_demanda")


def attribute_values(tables: DemandTables, cfg: DimensionConfig) -> DataFrame:
    """The registry's attribute values of the kept demands, one row per (demand, attribute, value)."""
    return latest_values(eav_rows(tables, _registry_ids(cfg), kept_demands(tables, cfg)))


def write_attributes(tables: DemandTables, cfg: DimensionConfig | None = None) -> Stored:
    """Run ``attribute_values`` once and write it: one read of the bridge and one of the values.

    Pass the result's ``df`` as ``values`` to ``demand_dimension``, and ``remove`` it after the report
    is written (or use it as a context manager). Written without an office, it serves every office.

    Texts that their role cannot read raise ``BadAttributeValues``, which names role, attribute, count and a
    demand; they are counted while the table is written. ``checks.bad_values`` lists them.
    """
    cfg = cfg or DimensionConfig()
    values, seen = observed(attribute_values(tables, cfg), cfg)
    stored = write_shared(values, "attributes", partition_by="id_dado")
    try:
        raise_if_bad(seen, cfg)
    except BadAttributeValues:
        stored.remove()
        raise
    return stored


def _multi(cfg: DimensionConfig) -> dict:
    return {n: a for n, a in cfg.attributes.items() if a.pick == ALL}


def _scalars_single_pass(cfg, base, values):
    scalar = {n: a for n, a in cfg.attributes.items() if a.pick in (LATEST, MAX_DATE)}
    # a required multi-valued attribute needs no test here: without a value its product is empty
    present = {n: a for n, a in scalar.items() if a.required or n == "municipio"}
    df = scalar_picks(values, scalar, present.items(), cfg.date_formats, demands=base)
    required = [F.col(f"has_{n}").isNotNull() for n, a in scalar.items() if a.required]
    if required:
        df = df.where(reduce(lambda a, b: a & b, required))
    gate = F.col("has_municipio")
    return df.select(*[gated(c, gate).alias(c) if c in _GATED else F.col(c) for c in df.columns])


def _scalars_per_attribute(tables, cfg, base):
    demands = base.select("id_demanda")
    df = base
    local = {}
    for n, a in cfg.attributes.items():
        if a.pick == ALL:
            continue
        rows = eav_rows(tables, a.ids, demands)
        # tied greatest dates are one value; fold them so they do not multiply rows
        picked = pick_latest(rows, n) if a.pick == LATEST else pick_max_date(rows, n, cfg.date_formats).distinct()
        if n in ("municipio",) + _GATED:
            local[n] = picked
            continue
        df = df.join(picked, "id_demanda", "inner" if a.required else "left")
    place = gated_left_chain(local["municipio"], local["uf"], local["aerodromo"])
    return df.join(place, "id_demanda", "left")


def _derived(name: str, value: Column, cfg: DimensionConfig) -> list[Column]:
    """The report columns of a multi-valued attribute's text, under internal names."""
    cast = cfg.attributes[name].cast
    if cast == "int":
        value = strict_int(value)
    elif cast == "date":
        value = strict_date(value, cfg.date_formats)
    if name == "cliente":
        return [substr(value, 5, 7).alias("gerencia"), substr(value, 1, 3).alias("superint")]
    if name == "nup":
        return [value.alias("nup"), strict_int(substr(value, 14, 4)).alias("ano_nup")]
    return [value.alias(name)]


def _role_members(cfg: DimensionConfig, values: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """The multi-valued roles' values as members of the product (roles 1 and up), from one read of ``values``.

    A text is cast only under the role that owns it, as a value of that role's column.
    """
    multi = _multi(cfg)
    owners = [F.when(id_filter(a.ids), F.lit(i)) for i, a in enumerate(multi.values(), start=1)]
    rows = values.where(id_filter([x for a in multi.values() for x in a.ids]))
    rows = rows.select("id_demanda", "nm_valor", F.explode(F.array_compact(F.array(*owners))).alias("role"))
    columns, schemas = [], []
    for i, n in enumerate(multi, start=1):
        parts = _derived(n, F.col("nm_valor"), cfg)
        columns.append(F.when(F.col("role") == i, F.struct(*parts)).alias(value_column(i)))
        schemas.append(["gerencia", "superint"] if n == "cliente" else ["nup", "ano_nup"] if n == "nup" else [n])
    return rows.select("id_demanda", "role", *columns), schemas


def _fan_out(narrow: DataFrame, values: DataFrame, cfg: DimensionConfig) -> DataFrame:
    """``narrow`` with every combination of the roles' values; a missing year reads as the year of the planned start."""
    members, schemas = _role_members(cfg, values)
    members = member_rows(narrow, 0).unionByName(members, allowMissingColumns=True)
    names = list(_multi(cfg))
    optional = [i for i, n in enumerate(names, start=1) if not cfg.attributes[n].required]
    fill = (names.index("ano_prev") + 1, lambda plain: F.year(plain["ini_prev"]))
    own = [c for c in narrow.columns if c != "id_demanda"]
    return product(members, [own, *schemas], cfg.fanout_rows_per_task, optional, fill, block=cfg.fanout_block)


def _narrow(df: DataFrame, cfg: DimensionConfig) -> DataFrame:
    """The report values that need no multi-valued attribute, under internal names."""
    c = F.col
    return df.select(
        "id_demanda",
        to_day("dt_cadastro").alias("cadastro"),
        "situacao",
        c("nm_login_cadastrador").alias("solicitante"),
        F.coalesce(c("nurac"), F.lit(cfg.office_missing)).alias("nurac"),
        "nm_status_demanda",
        F.when(c("term_prev").isNotNull(), month_name("term_prev", cfg.month_names))
        .otherwise(substr("mes_prev", 6, 10))
        .alias("mes_prev"),
        place_label("municipio", "uf").alias("local"),
        "aerodromo",
        "etapa",
        executor_label(
            "nm_login_executor", "nm_status_demanda", cfg.completed_status, cfg.finished_executor, cfg.no_executor
        ).alias("executor"),
        F.coalesce(c("sit"), F.lit(cfg.capture_default)).alias("sit"),
        "ini_prev",
        "term_prev",
    )


# Internal columns in the order of REPORT_COLUMNS.
_REPORT_SOURCES = (
    "id_demanda", "cadastro", "nup", "ano_nup", "gerencia", "superint", "tp_insp", "linha_pta", "situacao",
    "solicitante", "nurac", "nm_status_demanda", "ano_prev", "mes_prev", "mes_exec", "local", "aerodromo", "etapa",
    "executor", "sit", "ini_prev", "term_prev", "data_exec",
)


def demand_dimension(
    tables: DemandTables,
    cfg: DimensionConfig | None = None,
    plan: str = "single_pass",
    sort: bool = True,
    values: DataFrame | None = None,
) -> DataFrame:
    """The demand dimension (23 report columns), distinct rows, sorted by demand number.

    ``values`` is the table ``write_attributes`` wrote, for the single pass; without it the same
    values are computed within the query.
    """
    cfg = cfg or DimensionConfig()
    if plan not in PLANS:
        raise ValueError(f"unknown plan {plan!r}; expected one of {PLANS}")
    if plan == "single_pass":
        values = attribute_values(tables, cfg) if values is None else values
        kept = kept_demands(tables, cfg, values)
        scalars = _scalars_single_pass(cfg, _base(tables, cfg, kept), values.join(kept, "id_demanda", "left_semi"))
        narrow = _narrow(scalars.join(_stages(tables, cfg, kept), "id_demanda"), cfg)
        out = _fan_out(narrow, values.join(kept, "id_demanda", "left_semi"), cfg)
    else:
        out = _joined_per_attribute(tables, cfg)
    completed = F.col("nm_status_demanda") == F.lit(cfg.completed_status)
    out = out.withColumn("mes_exec", F.when(completed, month_name("data_exec", cfg.month_names)))
    if sort:
        # by demand number; cell and place only let the range partitioning split a demand with very many rows
        out = out.orderBy("id_demanda", "cell", "place")
    return out.select(*[F.col(c).alias(r) for c, r in zip(_REPORT_SOURCES, REPORT_COLUMNS)])


def _stages(tables: DemandTables, cfg: DimensionConfig, kept: DataFrame) -> DataFrame:
    return stages_and_flag(
        tables, cfg.stage_version, cfg.stage_rules, cfg.stage_default, cfg.capture_from, cfg.capture_to, cfg.capture_label, kept
    )


def _joined_per_attribute(tables: DemandTables, cfg: DimensionConfig) -> DataFrame:
    """The original shape: inner joins for required attributes, LEFT JOINs for the others, one key, one distinct."""
    base = _base(tables, cfg)
    df = _scalars_per_attribute(tables, cfg, base)
    if cfg.office is not None:
        df = df.where(F.col("nurac") == F.lit(cfg.office))
    stages = current_stage(stage_log(tables, cfg.stage_version), cfg.stage_rules, cfg.stage_default, cfg.as_of)
    df = df.join(stages.select("id_demanda", "nm_login_executor", "etapa"), "id_demanda")
    capture = existence_flag(tables, cfg.capture_from, cfg.capture_to, cfg.capture_label, cfg.stage_version)
    out = _narrow(df.join(capture, "id_demanda", "left"), cfg).distinct()
    for n, a in _multi(cfg).items():
        vals = pick_all(eav_rows(tables, a.ids, base.select("id_demanda")), n).select("id_demanda", *_derived(n, F.col(n), cfg)).distinct()
        out = out.join(vals, "id_demanda", "inner" if a.required else "left")
    out = out.withColumn("ano_prev", F.coalesce("ano_prev", F.year("ini_prev"))).distinct()
    return out.withColumns({"cell": F.lit(0), "place": F.lit(0)})


def planned_business_days(tables: DemandTables, cfg: DimensionConfig | None = None) -> DataFrame:
    """Business days between the greatest planned start and end date of each demand.

    Demands with a planned start (a row of ``ini_prev``); 1 when the planned end is missing,
    else Monday-to-Friday days of [start, end] minus ``cfg.holidays``. Output: id_demanda,
    dias_uteis_previstos. One aggregation over the two attributes' rows.
    """
    cfg = cfg or DimensionConfig()
    attrs = {n: cfg.attributes[n] for n in ("ini_prev", "term_prev")}
    ids = list(dict.fromkeys(i for a in attrs.values() for i in a.ids))
    demands = spine(tables, cfg.version).select("id_demanda")
    values = latest_values(eav_rows(tables, ids, demands))
    picks = scalar_picks(values, attrs, [("ini_prev", attrs["ini_prev"])], cfg.date_formats, demands=demands)
    return picks.where(F.col("has_ini_prev").isNotNull()).select(
        "id_demanda",
        F.when(F.col("term_prev").isNull(), F.lit(1))
        .otherwise(business_days("ini_prev", "term_prev", cfg.holidays))
        .alias("dias_uteis_previstos"),
    )
