"""Table schemas and loaders."""

from dimweave.sources.buckets import load_bucketed, save_bucketed
from dimweave.sources.jdbc import load_jdbc
from dimweave.sources.schemas import SCHEMAS, TABLES
from dimweave.sources.sinks import read_in_order, refresh_office, save_table, write_ordered, write_parquet
from dimweave.sources.tables import DemandTables, from_rows, load_catalog, load_parquet

__all__ = [
    "SCHEMAS",
    "TABLES",
    "DemandTables",
    "from_rows",
    "load_bucketed",
    "load_catalog",
    "load_jdbc",
    "load_parquet",
    "read_in_order",
    "refresh_office",
    "save_bucketed",
    "save_table",
    "write_ordered",
    "write_parquet",
]
