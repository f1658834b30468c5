"""Reading the live database in parallel slices that hold about as many rows each.

Ids of an operational database are not evenly spread: deleted ranges, imports and one busy demand leave some
equal-width ranges empty and others huge. So the slices are cut at quantiles of the key, found by one query
in the database, and each slice is one ``WHERE`` condition. The conditions are disjoint and cover every row,
NULL keys too. The job's own conditions (process version, attribute ids) go along, so the database sends
only rows that the dimension can use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from dimweave.config import DimensionConfig
from dimweave.sources.schemas import TABLES
from dimweave.sources.tables import DemandTables

# Large tables are read in slices of their key; the dimensions in one query.
SLICE_KEYS = {
    "demanda": "id_demanda",
    "demanda_dado": "id_demanda",
    "dado_valor": "id_dado_valor",
    "demanda_etapa": "id_demanda",
}


def sql_literal(value) -> str:
    """An integer or text as SQL text (quotes doubled)."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise TypeError(f"neither an integer nor text: {value!r}")
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def quantile_query(table: str, key: str, slices: int, condition: str = "") -> str:
    """SQL for the least key of each of ``slices`` equally long runs of the table's rows."""
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT min(k) AS cut FROM (SELECT {key} AS k, ntile({int(slices)}) OVER (ORDER BY {key}) AS slice FROM {table}{where}) s GROUP BY slice"


def slice_predicates(key: str, cuts: Sequence, condition: str = "") -> list[str]:
    """Conditions that split the rows at ``cuts`` (each the first key of a slice): disjoint, and all rows are in one.

    Repeated and NULL cuts are dropped. Keys below the first cut, and NULL keys, are in the first slice.
    """
    at = [sql_literal(c) for c in sorted({c for c in cuts if c is not None})[1:]]
    if not at:
        parts = ["1 = 1"]
    else:
        inner = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(at, at[1:])]
        parts = [f"({key} < {at[0]} OR {key} IS NULL)", *inner, f"{key} >= {at[-1]}"]
    return [f"{p} AND ({condition})" if condition else p for p in parts]


def job_conditions(cfg: DimensionConfig, id_dado_on_bridge: bool = False, prefix: str = "") -> dict[str, str]:
    """The rows of each large table that the dimension of ``cfg`` can use, as SQL conditions."""
    ids = sorted({i for a in cfg.attributes.values() for i in a.ids}, key=str)
    wanted = f"id_dado IN ({', '.join(map(sql_literal, ids))})"
    out = {"demanda_dado" if id_dado_on_bridge else "dado_valor": wanted}
    if cfg.version is not None:
        own = f"id_versao_processo = {sql_literal(cfg.version)}"
        of_version = f"id_demanda IN (SELECT id_demanda FROM {prefix}demanda WHERE {own})"
        out["demanda"] = own
        out["demanda_etapa"] = of_version
        out["demanda_dado"] = f"{out['demanda_dado']} AND {of_version}" if "demanda_dado" in out else of_version
    return out


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict,
    cfg: DimensionConfig | None = None,
    slices: int = 64,
    schema: str | None = None,
    cuts: Mapping[str, Sequence] | None = None,
    id_dado_on_bridge: bool = False,
) -> DemandTables:
    """Read the live operational database over JDBC.

    Each large table is read by ``slices`` queries. ``cuts`` gives a table's cuts where they are known;
    otherwise the database is asked for them. With ``cfg`` only rows the job can use are sent. Timestamps
    without zone stay without zone, so their days depend on no session's time zone.
    """
    reader = spark.read.option("preferTimestampNTZ", "true")
    prefix = f"{schema}." if schema else ""
    conditions = job_conditions(cfg, id_dado_on_bridge, prefix) if cfg else {}
    frames = {}
    for name in TABLES:
        if name not in SLICE_KEYS:
            frames[name] = reader.jdbc(url, prefix + name, properties=properties)
            continue
        key, condition = SLICE_KEYS[name], conditions.get(name, "")
        at = (cuts or {}).get(name)
        if at is None:
            query = f"({quantile_query(prefix + name, key, slices, condition)}) cuts"
            at = [r[0] for r in reader.jdbc(url, query, properties=properties).collect()]  # one row a slice
        frames[name] = reader.jdbc(url, prefix + name, predicates=slice_predicates(key, at, condition), properties=properties)
    return DemandTables(**frames)
