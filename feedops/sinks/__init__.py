"""Writing results: CSV, JSON, text lines, parquet, record tables."""

from feedops.sinks.files import (
    write_change_log,
    write_csv,
    write_json,
    write_lines,
    write_parquet,
    write_records,
)

__all__ = ["write_change_log", "write_csv", "write_json", "write_lines", "write_parquet", "write_records"]
