"""dimweave: flat report dimensions from entity-attribute-value workflow data, on Spark.

The library turns a workflow database in which each demand's attributes are stored as
entity-attribute-value rows (``demanda`` / ``demanda_dado`` / ``dado_valor``) and its progress as a
stage log (``demanda_etapa`` / ``elemento_pn``) into a report-ready demand dimension.

Layout
------
``sources``    table schemas, loaders (Parquet, catalog, JDBC) and the testdata surrogate
``functions``  column helpers: strict casts, first-match labels, month names, business days
``operators``  DataFrame operators: EAV lookup, latest / all / greatest-date picks, current stage,
               existence flags, gated joins, role-playing dimensions, size-checked broadcast
``plans``      the demand dimension, as a single pass over the attribute table (default) and as
               one join per attribute (kept for equivalence checks)
``streaming``  the latest-value pick over a stream of attribute rows
``queries``    the registered queries over the testdata and their DuckDB oracle SQL
"""

from dimweave.config import ALL, LATEST, MAX_DATE, Attribute, DimensionConfig
from dimweave.plans.dimension import demand_dimension
from dimweave.sources.tables import DemandTables

__all__ = [
    "ALL",
    "LATEST",
    "MAX_DATE",
    "Attribute",
    "DemandTables",
    "DimensionConfig",
    "demand_dimension",
]
