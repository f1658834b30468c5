"""Schemas of the six workflow tables (inferred from use; the source ships no DDL)."""

from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


DEMANDA = _struct(
    ("id_demanda", _L),
    ("id_versao_processo", _I),
    ("dt_cadastro", _TS),
    ("nm_login_cadastrador", _S),
    ("id_status_demanda", _I),
)
DEMANDA_DADO = _struct(("id_demanda", _L), ("id_dado_valor", _L), ("dt_cadastro", _TS))
# on dado_valor here; a source may have it on demanda_dado instead
ID_DADO = _I
DADO_VALOR = _struct(("id_dado_valor", _L), ("id_dado", ID_DADO), ("nm_valor", _S))
DEMANDA_ETAPA = _struct(
    ("id_demanda_etapa", _L),
    ("id_demanda", _L),
    ("nm_login_executor", _S),
    ("id_elemento_pn_inicial", _I),
    ("id_elemento_pn_passagem", _I),
    ("nr_lead_time", _D),
    ("dt_inicio", _TS),
    ("dt_fim", _TS),
)
ELEMENTO_PN = _struct(("id_elemento_pn", _I), ("nm_elemento_pn", _S), ("id_versao_processo", _I))
STATUS_DEMANDA = _struct(("id_status_demanda", _I), ("nm_status_demanda", _S))

SCHEMAS = {
    "demanda": DEMANDA,
    "demanda_dado": DEMANDA_DADO,
    "dado_valor": DADO_VALOR,
    "demanda_etapa": DEMANDA_ETAPA,
    "elemento_pn": ELEMENTO_PN,
    "status_demanda": STATUS_DEMANDA,
}
TABLES = tuple(SCHEMAS)
