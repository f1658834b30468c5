"""The six workflow tables as one bundle of DataFrames, and ways to load them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dimweave.sources.schemas import ID_DADO, SCHEMAS, TABLES


@dataclass(frozen=True)
class DemandTables:
    """Demands, their attribute bridge and values, stage log and the two small dimensions.

    ``id_dado`` may live on either ``dado_valor`` (the default) or ``demanda_dado``; the
    attribute operators look it up on whichever carries it, so the filter on attribute ids is
    pushed to that table's scan. ``values_beside_bridge`` says that the two are bucketed alike by value id,
    so joining them needs no shuffle and comes before any join by demand.
    """

    demanda: DataFrame
    demanda_dado: DataFrame
    dado_valor: DataFrame
    demanda_etapa: DataFrame
    elemento_pn: DataFrame
    status_demanda: DataFrame
    values_beside_bridge: bool = False

    def __post_init__(self):
        need = {
            "demanda": {"id_demanda", "id_versao_processo", "dt_cadastro", "nm_login_cadastrador", "id_status_demanda"},
            "demanda_dado": {"id_demanda", "id_dado_valor", "dt_cadastro"},
            "dado_valor": {"id_dado_valor", "nm_valor"},
            "demanda_etapa": {
                "id_demanda_etapa",
                "id_demanda",
                "nm_login_executor",
                "id_elemento_pn_inicial",
                "id_elemento_pn_passagem",
                "dt_fim",
            },
            "elemento_pn": {"id_elemento_pn", "nm_elemento_pn", "id_versao_processo"},
            "status_demanda": {"id_status_demanda", "nm_status_demanda"},
        }
        for f in fields(self):
            if f.name not in need:
                continue
            have = set(getattr(self, f.name).columns)
            lacking = need[f.name] - have
            if lacking:
                raise ValueError(f"{f.name} lacks columns {sorted(lacking)}")
        on_bridge = "id_dado" in self.demanda_dado.columns
        on_value = "id_dado" in self.dado_valor.columns
        if on_bridge == on_value:
            raise ValueError("id_dado must be a column of exactly one of demanda_dado, dado_valor")

    @property
    def id_dado_on_bridge(self) -> bool:
        return "id_dado" in self.demanda_dado.columns


def load_parquet(spark: SparkSession, base: str, enforce_schema: bool = True) -> DemandTables:
    """Read ``{base}/{table}`` (a Parquet file or directory) for each of the six tables.

    With ``enforce_schema`` the declared types are used, so a column of the wrong type fails when it
    is read. A table's column names are read from its files first (one footer): ``id_dado`` is taken
    from whichever of ``demanda_dado`` and ``dado_valor`` has it, and any other declared column that
    is missing raises instead of reading as NULL.
    """
    frames = {}
    for name in TABLES:
        path = f"{base.rstrip('/')}/{name}"
        found = spark.read.parquet(path)
        if enforce_schema:
            have = set(found.columns)
            declared = SCHEMAS[name]
            if name in ("demanda_dado", "dado_valor"):
                rest = [f for f in declared.fields if f.name != "id_dado"]
                declared = T.StructType(rest + ([T.StructField("id_dado", ID_DADO)] if "id_dado" in have else []))
            lacking = [f.name for f in declared.fields if f.name not in have]
            if lacking:
                raise ValueError(f"{path} lacks columns {lacking}")
            found = spark.read.schema(declared).parquet(path)
        frames[name] = found
    return DemandTables(**frames)


def load_catalog(spark: SparkSession, database: str | None = None) -> DemandTables:
    """Tables registered in the session catalog (Hive metastore, Unity, Glue, ...)."""
    prefix = f"{database}." if database else ""
    return DemandTables(**{name: spark.table(prefix + name) for name in TABLES})


def from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> DemandTables:
    """Small in-memory tables with the declared schemas (tests, examples)."""
    return DemandTables(**{name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]) for name in TABLES})
