"""Reading and writing tables."""

from .csv import FILE_ORDER, NA_TOKENS, csv_header, read_csv
from .formats import ArrowFiles, TableFormat, register_format
from .tables import (
    RunMetrics,
    append_to,
    can_open,
    copy_table,
    file_report,
    open_table,
    processed_path,
    register_reader,
    scan_directory,
    split_source,
    write_table,
)
from .workbook import read_workbook, scan_workbooks, sheet_names

__all__ = [name for name in dir() if not name.startswith("_")]
