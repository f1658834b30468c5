"""The testdata tables read as the six workflow tables.

The driver's testdata (TPC-H-like tables plus an ``events`` stream) has no workflow database,
so its tables are mapped onto one, as Spark projections of the given tables (no data is
invented; every row derives from a testdata row, so the work grows with the scale factor):

``demanda``         customer: c_custkey, c_mktsegment as process version, c_nationkey as status,
                    c_name as registrant, registration time = 2023-01-01 + c_custkey hours
``status_demanda``  nation: n_nationkey, n_name
``demanda_dado``    events: user_id, event_id, ts (NULL when event_id % 11 = 0)
``dado_valor``      events: event_id; attribute id = event type and (event_id // 5) % 3, 15 in all, or
                    'none' for the attribute whose place in ``EVENT_TYPES`` x 3 is user_id % 17 (so every
                    role is missing for some demands); a text per event type (NULL when
                    event_id % 13 = 0), see ``_value_text``
``demanda_etapa``   orders: o_orderkey as stage id, o_custkey, element (priority digit - 1) * 5 +
                    (0, 1, 2 for status F, O, P), next element = element + 5 unless status 'P',
                    start o_orderdate, end o_orderdate + (o_orderkey % 30) days unless status
                    'O', executor '' when o_orderkey % 5 = 0, NULL when % 7 = 0, else 'clerk' +
                    priority digit
``elemento_pn``     nation: n_nationkey as element, n_name, n_regionkey as process version

The testdata has no NULL times, NULL values, empty executors or time ties; the modulo rules
inject them (as values; no rule removes a row) so the NULL-ordering and relabelling semantics
are exercised. The process version of the elements is the nation's region, so the version's
stages are the finished orders. The same rules are
restated in SQL by ``dimweave.queries.oracle`` for the DuckDB check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimweave.config import ALL, LATEST, MAX_DATE, Attribute, DimensionConfig
from dimweave.functions.dates import ntz_literal
from dimweave.sources.tables import DemandTables

TESTDATA_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The event types, in the order the attribute places count them.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _attribute_id() -> F.Column:
    c = F.col
    part = F.pmod(F.floor(c("event_id") / 5), F.lit(3)).cast("int")
    place = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), c("event_type")).cast("int") - 1
    name = F.concat(c("event_type"), F.lit("_"), part.cast("string"))
    return F.when(c("user_id") % 17 == place * 3 + part, F.lit("none")).otherwise(name)


def _value_text() -> F.Column:
    c = F.col
    ident = F.lpad(c("user_id").cast("string"), 5, "0")
    purchase = F.concat(
        ident,
        F.lit("."),
        F.lpad(c("user_id").cast("string"), 6, "0"),
        F.lit("/"),
        (F.lit(2023) + c("event_id") % 2).cast("string"),
        F.lit("-11"),
    )
    return (
        F.when(c("event_id") % 13 == 0, F.lit(None).cast("string"))
        .when(
            c("event_type") == "view",
            F.date_add(c("ts").cast("date"), F.when(_attribute_id() == "view_1", c("event_id") % 9).otherwise(0).cast("int")).cast("string"),
        )
        .when(c("event_type") == "signup", F.when(c("event_id") % 3 == 0, F.lit("BHZ")).otherwise(F.lit("SAO")))
        .when(c("event_type") == "purchase", purchase)
        .when(c("event_type") == "click", (F.lit(2023) + c("event_id") % 3).cast("string"))
        .otherwise(F.concat(F.lit(" "), c("props"), F.lit(" ")))
    )


def demanda(customer: DataFrame) -> DataFrame:
    c = F.col
    return customer.select(
        c("c_custkey").alias("id_demanda"),
        c("c_mktsegment").alias("id_versao_processo"),
        F.timestamp_add("HOUR", c("c_custkey"), ntz_literal(dt.datetime(2023, 1, 1))).alias(
            "dt_cadastro"
        ),
        c("c_name").alias("nm_login_cadastrador"),
        c("c_nationkey").alias("id_status_demanda"),
    )


def status_demanda(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").alias("id_status_demanda"), F.col("n_name").alias("nm_status_demanda")
    )


def demanda_dado(events: DataFrame) -> DataFrame:
    c = F.col
    return events.select(
        c("user_id").alias("id_demanda"),
        c("event_id").alias("id_dado_valor"),
        F.when(c("event_id") % 11 == 0, F.lit(None)).otherwise(c("ts")).alias("dt_cadastro"),
    )


def dado_valor(events: DataFrame) -> DataFrame:
    c = F.col
    return events.select(
        c("event_id").alias("id_dado_valor"), _attribute_id().alias("id_dado"), _value_text().alias("nm_valor")
    )


def executor_login(orderkey="o_orderkey", priority="o_orderpriority") -> F.Column:
    k = F.col(orderkey)
    return (
        F.when(k % 5 == 0, F.lit(""))
        .when(k % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("clerk"), F.substring(priority, 1, 1)))
    )


def demanda_etapa(orders: DataFrame) -> DataFrame:
    c = F.col
    k = c("o_orderkey")
    # element: 5 per priority digit, plus 0 / 1 / 2 for status F / O / P (nations 0-24)
    status = F.when(c("o_orderstatus") == "F", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    element = ((F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 5 + status).cast("int")
    return orders.select(
        k.alias("id_demanda_etapa"),
        c("o_custkey").alias("id_demanda"),
        executor_login().alias("nm_login_executor"),
        element.alias("id_elemento_pn_inicial"),
        F.when(c("o_orderstatus") == "P", F.lit(None).cast("int")).otherwise(element + 5).alias("id_elemento_pn_passagem"),
        c("o_totalprice").alias("nr_lead_time"),
        c("o_orderdate").alias("dt_inicio"),
        F.when(c("o_orderstatus") == "O", F.lit(None))
        .otherwise(F.timestamp_add("DAY", k % 30, c("o_orderdate")))
        .alias("dt_fim"),
    )


def elemento_pn(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").alias("id_elemento_pn"),
        F.col("n_name").alias("nm_elemento_pn"),
        F.col("n_regionkey").alias("id_versao_processo"),
    )


_REGISTERED: dict[tuple, DemandTables] = {}


def surrogate_tables(spark: SparkSession, sf_dir: str) -> DemandTables:
    """The six workflow tables over one read of each testdata table used.

    The (lazy) table definitions are built once per session and folder, as tables are
    registered once in a catalog; every query still reads the files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REGISTERED:
        _REGISTERED[key] = _build(spark, sf_dir)
    return _REGISTERED[key]


def _build(spark: SparkSession, sf_dir: str) -> DemandTables:
    events, nation = read(spark, sf_dir, "events"), read(spark, sf_dir, "nation")
    return DemandTables(
        demanda=demanda(read(spark, sf_dir, "customer")),
        demanda_dado=demanda_dado(events),
        dado_valor=dado_valor(events),
        demanda_etapa=demanda_etapa(read(spark, sf_dir, "orders")),
        elemento_pn=elemento_pn(nation),
        status_demanda=status_demanda(nation),
    )


# Fixed values of the surrogate: roles bound to attribute ids (no two roles share one), versions, the
# capture move, element-name patterns, the completed status, the as-of instant and the holidays.
SURROGATE_ATTRIBUTES = {
    "situacao": Attribute(("error_0",), LATEST, required=True),
    "cliente": Attribute(("purchase_0",), ALL, required=True),
    "nup": Attribute(("purchase_1",), ALL, required=True),
    "nurac": Attribute(("signup_0",), LATEST),
    "mes_prev": Attribute(("error_1",), LATEST),
    "ano_prev": Attribute(("click_1",), ALL, cast="int"),
    "data_exec": Attribute(("view_2",), ALL, cast="date"),
    "municipio": Attribute(("error_2",), LATEST),
    "uf": Attribute(("click_0",), LATEST),
    "aerodromo": Attribute(("signup_1",), LATEST),
    "linha_pta": Attribute(("signup_2",), ALL),
    "tp_insp": Attribute(("click_2", "purchase_2"), ALL),
    "ini_prev": Attribute(("view_0",), MAX_DATE),
    "term_prev": Attribute(("view_1",), MAX_DATE),
}
# A wrong registry for the report of unreadable texts: years and dates sought among process numbers.
MISREAD_ATTRIBUTES = {
    **SURROGATE_ATTRIBUTES,
    "ano_prev": Attribute(("purchase_1",), ALL, cast="int"),
    "data_exec": Attribute(("purchase_1", "click_1"), ALL, cast="date"),
}
SURROGATE_STAGE_RULES = (
    ("%n%1%5", "Etapa 01"),
    ("%n%1%", "Etapa 02"),
    ("%5", "Etapa 03"),
    ("%n_0", "Etapa 04"),
)
PRIORITY_STAGE_RULES = (
    ("%urgent%", "Etapa 00"),
    ("%e%i%", "Etapa 01"),
    ("%not%", "Etapa 02"),
    ("%high%", "Etapa 03"),
)
SURROGATE_VERSION = "BUILDING"
SURROGATE_ELEMENT_VERSION = 0
SURROGATE_CAPTURE = (5, 10)
SURROGATE_COMPLETED = "NATION_3"
SURROGATE_AS_OF = dt.datetime(2025, 1, 1)
SURROGATE_HOLIDAYS = tuple(d for y in range(1992, 2003) for d in (dt.date(y, 1, 1), dt.date(y, 12, 25)))

SURROGATE_CONFIG = DimensionConfig(
    version=SURROGATE_VERSION,
    element_version=SURROGATE_ELEMENT_VERSION,
    office="BHZ",
    capture_from=SURROGATE_CAPTURE[0],
    capture_to=SURROGATE_CAPTURE[1],
    attributes=dict(SURROGATE_ATTRIBUTES),
    stage_rules=SURROGATE_STAGE_RULES,
    completed_status=SURROGATE_COMPLETED,
    as_of=SURROGATE_AS_OF,
    holidays=SURROGATE_HOLIDAYS,
)
