"""Sources and sinks: Parquet, ORC, CSV, JSON and text, all with explicit schemas."""

from .files import TABLES, read, table, write

__all__ = ["TABLES", "read", "table", "write"]
