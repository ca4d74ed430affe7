from barloom.sources.sinks import replace_months, write_csv, write_json, write_ticks
from barloom.sources.text_files import parse_json, read_csv, read_json
from barloom.sources.tick_files import (
    broken_entries,
    clean_symbol,
    ensure_utc_timestamp,
    latest_months,
    list_months,
    month_files,
    month_range_label,
    normalize_ticks,
    read_ledger,
    read_ticks,
    unreadable_files,
    unreadable_months,
)

__all__ = [
    "broken_entries",
    "clean_symbol",
    "ensure_utc_timestamp",
    "latest_months",
    "list_months",
    "month_files",
    "month_range_label",
    "normalize_ticks",
    "parse_json",
    "read_csv",
    "read_json",
    "read_ledger",
    "read_ticks",
    "replace_months",
    "unreadable_files",
    "unreadable_months",
    "write_csv",
    "write_json",
    "write_ticks",
]
