"""Sources and sinks: explicit-schema table loading, the test-data mapping, report output."""

from .catalog import SCHEMAS, TABLE_NAMES, SchemaError, Tables, check_schema, load_tables, read_table
from .layout import BUCKETING, load_catalog_tables, save_bucketed
from .normalize import normalized
from .sinks import write_report
from .snapshots import SnapshotError, load_snapshot, publish, publish_tables, snapshot

__all__ = [
    "SCHEMAS", "TABLE_NAMES", "SchemaError", "Tables", "check_schema", "load_tables", "read_table",
    "write_report", "BUCKETING", "load_catalog_tables", "save_bucketed", "SnapshotError",
    "load_snapshot", "normalized", "publish", "publish_tables", "snapshot",
]
