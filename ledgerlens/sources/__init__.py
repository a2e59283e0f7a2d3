"""Scans and sinks: ledger bridge, CSV, JDBC, tables, payload records, report sinks."""

from .files import read_csv_ledger, read_table_ledger, map_na_tokens
from .jdbc import JdbcLedgerSource
from .ledger import ledger_frame, ledger_raw_frame, read_tables
from .payload import parse_payload, payload_violations, split_payload

__all__ = [
    "JdbcLedgerSource", "ledger_frame", "ledger_raw_frame", "map_na_tokens",
    "parse_payload", "payload_violations", "read_csv_ledger", "read_table_ledger",
    "read_tables", "split_payload",
]
