"""Sources (driver parquet tables, derived shop tables) and sinks."""

from .tables import DRIVER_SCHEMAS, ShopTables, load_tables, read_driver_table

__all__ = ["DRIVER_SCHEMAS", "ShopTables", "load_tables", "read_driver_table"]
