"""CSV scans: native reader where possible, line positions where rows are skipped."""

from __future__ import annotations

import csv as csv_text
import io
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.text import quoted
from gridweave.operators.positions import Range, as_ranges, in_ranges
from gridweave.operators.tables import infer_types as cast_inferred
from gridweave.sources.records import block_columns, quoted_records, with_block, written

# Texts that stand for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

BAD_ROWS = ("fail", "skip", "keep")

# Order of rows in files, for order_by: block start and row id rise along a file.
FILE_ORDER = ["_file", "_block", "_row"]

# Holds the line of a row whose number of fields is not the header's.
_UNEVEN = "__uneven"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str = ",",
    skip: str | int | Iterable[int] | None = None,
    bad_rows: str = "fail",
    na_tokens: Sequence[str] = tuple(NA_TOKENS),
    infer_types: bool = False,
    with_order: bool = False,
    file_pattern: str | None = None,
    glob: str | None = None,
    multi_line: bool = False,
    headers: str = "same",
) -> DataFrame:
    """Rows of one or more CSV files; the first row not skipped is each file's header.

    Columns are text unless ``infer_types``. Short rows are padded with nulls; rows with
    more fields than the header raise, are left out (``bad_rows="skip"``), or lose the
    extra fields (``"keep"``). ``with_order`` adds the ``FILE_ORDER`` columns.
    ``file_pattern`` keeps files whose name matches a regex anywhere. With ``multi_line`` quoted
    fields may hold line breaks, the header's too, and ``skip`` counts records; a file is
    still cut by as many tasks as it has splits.

    The files of one scan have one header, read off the first of them; another header in a
    file raises. ``headers="each"`` looks at every file, in a pass of its own, and matches columns by
    name: the order of columns and the lines before a header may then differ, not the names. Where the session
    doesn't tell upper from lower case, names that differ in case only count as repeated.
    """
    if headers not in ("same", "each"):
        raise ValueError(f"headers are 'same' or 'each', not {headers!r}")
    if bad_rows not in BAD_ROWS:
        raise ValueError(f"bad_rows is one of {BAD_ROWS}, not {bad_rows!r}")
    if len(sep) != 1:
        raise ValueError("the separator is one character")
    ranges = as_ranges(skip)
    numbered = _numbered(spark, path, glob, file_pattern, sep) if multi_line else None
    lines = None if multi_line else _lines(spark, path, glob, file_pattern)
    fold = _folds_case(spark)
    if headers == "each":
        numbered = numbered or _with_line_index(lines)
        layouts = _layouts(numbered, ranges)
        names = {frozenset(header_names(text, sep, fold)) for text, _ in layouts}
        if len(names) > 1:
            raise ValueError(f"files have different columns: {sorted(map(sorted, names))}")
        if len(layouts) > 1:
            rest = {
                "sep": sep, "skip": skip, "bad_rows": bad_rows, "na_tokens": na_tokens, "with_order": with_order, "multi_line": multi_line
            }
            parts = [read_csv(spark, files, **rest) for files in layouts.values()]
            rows = reduce(DataFrame.unionByName, parts)
            return cast_inferred(rows) if infer_types else rows
    header_line, header_index = _first_record(numbered, ranges) if multi_line else _header(lines, ranges)
    header = header_names(header_line, sep, fold)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    if bad_rows != "keep":
        schema = schema.add(_UNEVEN, T.StringType())
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _UNEVEN}
    order = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]
    # Spark compares every file's header with names that stand in the file as they are.
    if header_index == 0 and not ranges and not multi_line and header == _cells(header_line, sep):
        # A pruned parse cannot tell how many fields a row has.
        whole = bad_rows != "keep"
        reader = spark.read.schema(schema).options(header=True, columnPruning=not whole, enforceSchema=False, **options)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        rows = _named(reader.csv(path), file_pattern)
        fields = [quoted(c) for c in schema.names]
        rows = rows.select(*fields, *order) if with_order else rows.select(*fields)
    else:
        numbered = numbered or _with_line_index(lines)
        line = F.col("line")
        other = F.raise_error(F.lit("files have different headers; headers='each' looks at every file")).cast("boolean")
        wanted = (
            F.when(in_ranges(line, ranges), False)
            .when(line > header_index, F.trim("value") != "")
            .when(line == header_index, F.when(F.col("value") == header_line, False).otherwise(other))
            .otherwise(F.when(F.trim("value") == "", False).otherwise(other))
        )
        # As a generator the parse runs once per kept line, and no later filter can
        # move in front of the line filter and see skipped lines. Fields are parsed under
        # numbers, since names may be told apart by more than the parser does.
        numbers = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        numbers = numbers.add(_UNEVEN, T.StringType()) if bad_rows != "keep" else numbers
        parsed = F.inline(F.array(F.from_csv(F.col("value"), _ddl(numbers), options)))
        rows = numbered.where(wanted).select(parsed, *(FILE_ORDER if with_order else []))
        rows = rows.toDF(*schema.names, *(FILE_ORDER if with_order else []))
    rows = _judge(rows, bad_rows, header, sep)
    values = [_without_na(quoted(c), na_tokens).alias(c) for c in header]
    rows = rows.select(*values, *(FILE_ORDER if with_order else []))
    return cast_inferred(rows) if infer_types else rows


def csv_header(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str = ",",
    skip: str | int | Iterable[int] | None = None,
    multi_line: bool = False,
) -> list[str]:
    """Column names of a CSV, after skipped rows."""
    if multi_line:
        line, _ = _first_record(_numbered(spark, path, None, None, sep), as_ranges(skip))
    else:
        line, _ = _header(_lines(spark, path, None, None), as_ranges(skip))
    return header_names(line, sep, _folds_case(spark))


def header_names(line: str, sep: str = ",", fold: bool = False) -> list[str]:
    """Column names off a header; with ``fold``, names that differ in case only are repeated ones."""
    return unique_names(_cells(line, sep), fold)


def _cells(line: str, sep: str) -> list[str]:
    return next(csv_text.reader(io.StringIO(line.lstrip("\ufeff"), newline=""), delimiter=sep))


def unique_names(cells: Sequence[str | None], fold: bool = False) -> list[str]:
    """Header cells as names: empty ones become ``Unnamed: i``, repeats ``a.1``, ``a.2``."""
    alike = str.lower if fold else str
    given = {alike(c) for c in cells if c}
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = base = cell or f"Unnamed: {i}"
        count = 0
        while alike(name) in taken or (count and alike(name) in given):
            count += 1
            name = f"{base}.{count}"
        names.append(name)
        taken.add(alike(name))
    return names


def _folds_case(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.caseSensitive", "false").lower() != "true"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` STRING" for c in schema.names)


def _named(rows: DataFrame, file_pattern: str | None) -> DataFrame:
    # The file name is metadata, so files that do not match are never opened.
    return rows.where(F.col("_metadata.file_name").rlike(file_pattern)) if file_pattern else rows


def _lines(spark: SparkSession, path: str | Sequence[str], glob: str | None, file_pattern: str | None, **options: str) -> DataFrame:
    reader = spark.read.options(**options)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return _named(reader.text(path), file_pattern)


def _numbered(spark: SparkSession, path: str | Sequence[str], glob: str | None, file_pattern: str | None, sep: str) -> DataFrame:
    return quoted_records(_lines(spark, path, glob, file_pattern, lineSep="\n"), sep)


def _layouts(numbered: DataFrame, ranges: Sequence[Range]) -> dict[tuple[str, int], list[str]]:
    """The files of each header text and line. File names are what the driver lists for any scan."""
    wanted = numbered.where(~in_ranges(F.col("line"), ranges) & (F.trim("value") != ""))
    first = wanted.groupBy("_file").agg(F.min(F.struct("line", "value")).alias("h"))
    found: dict[tuple[str, int], list[str]] = {}
    for row in first.orderBy("_file").toLocalIterator():
        found.setdefault((row["h"]["value"], row["h"]["line"]), []).append(unquote(row["_file"]))
    return found


def _first_record(numbered: DataFrame, ranges: Sequence[Range]) -> tuple[str, int]:
    """The header and its number, off the file whose name comes first."""
    wanted = numbered.where(~in_ranges(F.col("line"), ranges) & (F.trim("value") != ""))
    found = wanted.agg(F.min(F.struct("_file", "line", "value")).alias("h")).first()["h"]
    if found is None:
        raise ValueError("there is no header: no file, or every row is skipped or blank")
    return found["value"], found["line"]


def _header(lines: DataFrame, ranges: Sequence[Range]) -> tuple[str, int]:
    # One file's first block lies in one task in line order, and a limit reads no
    # further than it needs: this look-up touches the head of one file.
    first_file = lines.select(F.col("_metadata.file_path")).limit(1).collect()
    if not first_file:
        raise ValueError("there is no header: no file, or only empty files")
    head = lines.where((F.col("_metadata.file_path") == first_file[0][0]) & (F.col("_metadata.file_block_start") == 0))
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = head.select("value", index.alias("line"))
    found = numbered.where(~in_ranges(F.col("line"), ranges) & (F.trim("value") != "")).limit(1).collect()
    if not found:
        raise ValueError("there is no header: every row is skipped or blank")
    return found[0]["value"], found[0]["line"]


def _with_line_index(lines: DataFrame) -> DataFrame:
    """Add ``line``, the physical 0-based line number within its file.

    Row ids rise by one along a block, so a line's number is the block's first line plus
    the distance of its id from the block's first id. The first pass counts lines per
    block (no line content, one row per block out); the second adds the numbers. Both
    must see the same splits: they are joined on task, file, block start and block
    length, and a line whose block is unknown raises.
    """
    scanned = lines.select(*block_columns(), "value")
    ids = ["_task", "_file", "_block", "_length"]
    counted = lines.select(*block_columns()).groupBy(*ids).agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*ids, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = with_block(scanned, written(starts))
    return numbered.select("_file", "_block", "_row", (F.col("base") + F.col("_row") - F.col("first")).alias("line"), "value")


def _judge(rows: DataFrame, bad_rows: str, header: Sequence[str], sep: str) -> DataFrame:
    if bad_rows == "keep":
        return rows
    # Only uneven lines are looked at again: separators are counted outside of quotes.
    bare = F.regexp_replace(_UNEVEN, '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    fits = F.col(_UNEVEN).isNull() | (fields <= len(header))
    # Spark refuses a scan of the line column alone, as a plain count would ask for.
    read = F.coalesce(F.length(quoted(header[0])), F.lit(0)) >= 0
    if bad_rows == "skip":
        return rows.where(read & fits)
    message = F.lit(f"a row has more than {len(header)} fields; bad_rows='skip' leaves such rows out")
    return rows.where(read & F.when(fits, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def _without_na(col: Column, tokens: Sequence[str]) -> Column:
    return F.when(~col.isin(list(tokens)), col) if tokens else col
