"""Opening and writing tables by path: the suffix picks the format."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.text import quoted
from gridweave.sources.csv import read_csv
from gridweave.sources.workbook import WORKBOOK_SUFFIXES, read_workbook

Reader = Callable[..., DataFrame]


def _columnar(format_name: str) -> Reader:
    def read(spark: SparkSession, path: str, **options) -> DataFrame:
        return spark.read.format(format_name).options(**options).load(path)

    return read


# Formats that Spark writes by name.
_FORMATS: dict[str, str] = {".parquet": "parquet", ".orc": "orc"}

_READERS: dict[str, Reader] = {
    ".csv": read_csv,
    **{suffix: read_workbook for suffix in WORKBOOK_SUFFIXES},
    ".parquet": _columnar("parquet"),
    ".orc": _columnar("orc"),
}


def register_reader(suffix: str, reader: Reader) -> None:
    """Make :func:`open_table` use ``reader(spark, path, **options)`` for a suffix not yet taken.

    For a whole format of one's own, that is also written, see :func:`gridweave.sources.register_format`.
    """
    _READERS.setdefault(_suffix("x" + suffix if suffix.startswith(".") else suffix), reader)


def add_format(suffix: str, name: str) -> None:
    """Read and write paths of a suffix by the data source ``name``; nothing changes if they already are."""
    if suffix in _READERS and _FORMATS.get(suffix) != name:
        raise ValueError(f"{suffix} has a reader already")
    _READERS[suffix] = _columnar(name)
    _FORMATS[suffix] = name


def _suffix(path: str) -> str:
    return posixpath.splitext(str(path))[1].lower()


def can_open(path: str) -> bool:
    return _suffix(path) in _READERS


def split_source(source: str) -> tuple[str, str | None]:
    """``path::sheet`` as path and sheet; the last ``::`` counts."""
    if not source or "::" not in source:
        return source, None
    path, sheet = source.rsplit("::", 1)
    return path, sheet or None


def open_table(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A DataFrame for a path or ``path::sheet``; a DataFrame passes through."""
    if isinstance(source, DataFrame):
        return source
    path, sheet = split_source(str(source))
    if not can_open(path):
        raise ValueError(f"no reader for {path!r}")
    if sheet:
        options["sheet"] = sheet
    return _READERS[_suffix(path)](spark, path, **options)


def processed_path(path: str) -> str:
    """Default output: ``<stem>_processed<suffix>`` beside the input."""
    stem, suffix = posixpath.splitext(path)
    return f"{stem}_processed{suffix}"


def scan_directory(spark: SparkSession, folder: str, pattern: str | None = None, **options) -> DataFrame:
    """All CSV files directly in a folder whose name matches a regex anywhere.

    A pattern that is no regex filters nothing. The filter is on file metadata, so
    files that do not match are not read.
    """
    if pattern and not _is_regex(spark, pattern):
        pattern = None
    return read_csv(spark, folder, glob="*.[cC][sS][vV]", file_pattern=pattern, **options)


def _is_regex(spark: SparkSession, pattern: str) -> bool:
    # The JVM that will run the pattern says whether it is one.
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def file_report(df: DataFrame) -> DataFrame:
    """``(file_name, file_size, row_count)`` per file of a file-based scan."""
    meta = df.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"))
    return meta.groupBy("file_name", "file_size").agg(F.count(F.lit(1)).alias("row_count"))


@dataclass(frozen=True)
class RunMetrics:
    rows: int
    elapsed: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.elapsed if self.elapsed > 0 else 0.0


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", sep: str = ",") -> RunMetrics:
    """Write a table in the format of the suffix (a folder of part files); CSV unless another is named.

    Rows are counted on the way out, so the metrics cost no second scan. An empty table
    still gets its header line.
    """
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    suffix = _suffix(path)
    if suffix in WORKBOOK_SUFFIXES:
        raise ValueError("workbooks are read, not written; write .csv or .parquet")
    start = time.monotonic()
    writer = watched.write.mode(mode)
    if suffix in _FORMATS:
        writer.format(_FORMATS[suffix]).save(path)
    else:
        writer.options(
            header=True,
            sep=sep,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    elapsed = time.monotonic() - start
    return RunMetrics(rows=seen.get.get("rows", 0), elapsed=elapsed)


def copy_table(spark: SparkSession, source: str, target: str, **options) -> RunMetrics:
    """Read one table, write it in the format of the target's suffix."""
    return write_table(open_table(spark, source, **options), target)


def append_to(df: DataFrame, path: str, *, sep: str = ",") -> RunMetrics:
    """Add rows to a table on disk, columns matched by name.

    Columns of the table that the rows lack become null; a column the table lacks is refused, since
    files written before could not be read with it.
    """
    spark, suffix = df.sparkSession, _suffix(path)
    reader = spark.read.format(_FORMATS[suffix]) if suffix in _FORMATS else spark.read.format("csv").options(header=True, sep=sep)
    try:
        there = reader.load(path).schema
    except AnalysisException as error:
        # What a data source written in Python raises has no condition of its own.
        if error.getCondition() not in ("PATH_NOT_FOUND", "PYTHON_DATA_SOURCE_ERROR"):
            raise
        return write_table(df, path, mode="append", sep=sep)
    if more := sorted(set(df.columns) - set(there.names)):
        raise ValueError(f"the table at {path} has no column {', '.join(more)}")
    typed = suffix in _FORMATS
    columns = [
        (quoted(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)) for f in there
    ]
    columns = [(c.cast(f.dataType) if typed else c).alias(f.name) for c, f in zip(columns, there, strict=True)]
    return write_table(df.select(*columns), path, mode="append", sep=sep)

