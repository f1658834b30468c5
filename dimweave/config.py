"""Job parameters and the attribute registry of the demand dimension.

Every constant of the source job is a field here, so the same plan runs for another process
version, another regional office, or the testdata surrogate (``dimweave.sources.surrogate``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# How one attribute's value rows are reduced per demand.
LATEST = "latest"  # newest row by bridge time, NULL time first, then newest value id
ALL = "all"  # every value row (multi-valued: the result fans out, one row per value)
MAX_DATE = "max_date"  # the greatest value read as a date, NULL first, ties kept

PICKS = (LATEST, ALL, MAX_DATE)


@dataclass(frozen=True)
class Attribute:
    """One logical attribute of a demand, stored under one or more ``id_dado`` ids.

    ``required`` attributes are inner-joined into the dimension (a demand without one is
    dropped); the others are left-joined. ``cast`` is applied to the picked value of an
    ``ALL`` attribute (``"int"`` or ``"date"``); ``MAX_DATE`` always reads dates.
    """

    ids: tuple
    pick: str
    required: bool = False
    cast: str | None = None

    def __post_init__(self):
        if self.pick not in PICKS:
            raise ValueError(f"unknown pick {self.pick!r}; expected one of {PICKS}")
        if self.cast not in (None, "int", "date"):
            raise ValueError(f"unknown cast {self.cast!r}")
        if not self.ids:
            raise ValueError("an attribute needs at least one id_dado")


# Roles the dimension reads, each bound to an Attribute in DimensionConfig.attributes.
ROLES = (
    "situacao",
    "cliente",
    "nup",
    "nurac",
    "mes_prev",
    "ano_prev",
    "data_exec",
    "municipio",
    "uf",
    "aerodromo",
    "linha_pta",
    "tp_insp",
    "ini_prev",
    "term_prev",
)

# The pick each role is read with: one value per demand, or one row per value (fan-out).
ROLE_PICKS = {
    **{r: (LATEST,) for r in ("situacao", "nurac", "mes_prev", "municipio", "uf", "aerodromo")},
    **{r: (MAX_DATE,) for r in ("ini_prev", "term_prev")},
    **{r: (ALL,) for r in ("cliente", "nup", "ano_prev", "data_exec", "linha_pta", "tp_insp")},
}

# ---------------------------------------------------------------------------------------------
# Fixed values of the source job. They must stay exactly as written for the dimension to
# match the original report: attribute ids (id_dado) per role, the process version, the
# regional office, the workflow element ids of the "captured by the office" step, the ordered
# stage-name patterns with their labels, the fixed labels, and the month names of the report's
# (Portuguese) locale.
# ---------------------------------------------------------------------------------------------
SOURCE_ATTRIBUTES = {
    "situacao": Attribute((4632,), LATEST, required=True),
    "cliente": Attribute((4599,), ALL, required=True),
    "nup": Attribute((35,), ALL, required=True),
    "nurac": Attribute((3780,), LATEST),
    "mes_prev": Attribute((4605,), LATEST),
    "ano_prev": Attribute((4694,), ALL, cast="int"),
    "data_exec": Attribute((4654,), ALL, cast="date"),
    "municipio": Attribute((4270,), LATEST),
    "uf": Attribute((4269,), LATEST),
    "aerodromo": Attribute((124,), LATEST),
    "linha_pta": Attribute((4623,), ALL),
    "tp_insp": Attribute((4594, 4595, 4596, 4597, 4598, 4600, 4689, 4656), ALL),
    "ini_prev": Attribute((4604,), MAX_DATE),
    "term_prev": Attribute((4647,), MAX_DATE),
}
SOURCE_VERSION = 8747
SOURCE_OFFICE = "BHZ"
SOURCE_CAPTURE_FROM = 106298
SOURCE_CAPTURE_TO = 106308
SOURCE_STAGE_RULES = (
    ("%entrada%do%processo%sei%", "Etapa 00"),
    ("%conferir%cadastro%", "Etapa 01"),
    ("%distribuir%atividade%exec%", "Etapa 02"),
    ("%verificar%disponibilidade%exec%", "Etapa 03"),
    ("%verificar%proposta%andamento%", "Etapa 04"),
    ("%emitir%o%s%", "Etapa 05"),
    ("%executar%atividade%", "Etapa 06"),
)
STAGE_DEFAULT = "Demanda Finalizada"
CAPTURE_LABEL = "Cadastrada pelo NURAC"
CAPTURE_DEFAULT = "Cadastrada pela GTREG"
COMPLETED_STATUS = "Concluída"
FINISHED_EXECUTOR = "Demanda Finalizada"
NO_EXECUTOR = "Sem Executor"
OFFICE_MISSING = "N.D."
MONTH_NAMES_PT = (
    "Janeiro",
    "Fevereiro",
    "Março",
    "Abril",
    "Maio",
    "Junho",
    "Julho",
    "Agosto",
    "Setembro",
    "Outubro",
    "Novembro",
    "Dezembro",
)
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DimensionConfig:
    """Parameters of ``demand_dimension``. Defaults reproduce the source job.

    ``version``          process version of demands and of their attribute rows (None: all)
    ``element_version``  process version of the workflow elements (None: same as ``version``)
    ``office``           regional office kept (None: every demand, a missing office reads 'N.D.')
    ``as_of``            closes open stage intervals; None reads the session's local time
    ``date_formats``     formats of date values stored as text, tried in order after ISO
    ``holidays``         dates subtracted by the business-day count
    ``fanout_rows_per_task`` output rows of one demand above which its fan-out is split
    ``fanout_block``     values of one role in one demand above which they are cut into blocks
    """

    version: object = SOURCE_VERSION
    element_version: object = None
    office: str | None = SOURCE_OFFICE
    capture_from: object = SOURCE_CAPTURE_FROM
    capture_to: object = SOURCE_CAPTURE_TO
    attributes: dict = field(default_factory=lambda: dict(SOURCE_ATTRIBUTES))
    stage_rules: tuple = SOURCE_STAGE_RULES
    stage_default: str = STAGE_DEFAULT
    capture_label: str = CAPTURE_LABEL
    capture_default: str = CAPTURE_DEFAULT
    completed_status: str = COMPLETED_STATUS
    finished_executor: str = FINISHED_EXECUTOR
    no_executor: str = NO_EXECUTOR
    office_missing: str = OFFICE_MISSING
    month_names: tuple = MONTH_NAMES_PT
    date_formats: tuple = ()
    as_of: dt.datetime | None = None
    holidays: tuple = ()
    fanout_rows_per_task: int = 2_000_000
    fanout_block: int = 8192

    def __post_init__(self):
        missing = [r for r in ROLES if r not in self.attributes]
        if missing:
            raise ValueError(f"attribute registry lacks roles {missing}")
        for role, kinds in ROLE_PICKS.items():
            if self.attributes[role].pick not in kinds:
                raise ValueError(f"role {role!r} needs a pick in {kinds}, got {self.attributes[role].pick!r}")
        if len(self.month_names) != 12:
            raise ValueError("month_names needs 12 entries")

    @property
    def stage_version(self):
        return self.version if self.element_version is None else self.element_version

    def with_(self, **changes) -> DimensionConfig:
        return replace(self, **changes)
