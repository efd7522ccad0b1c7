"""Row positions: a 0-based index under a total order, and filters on it.

No operator here runs an unpartitioned window over the table. Positions near the
head come from a top-k; the general index splits the order into ranges by literal
bounds, so it needs no shared shuffle and gives the same numbers however often a
task or a stage runs again.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.text import free_name, quoted

Range = tuple[int, int]

INDEX = "idx"
# Positions below this come from a top-k held in one task; beyond it the full index is built.
HEAD_LIMIT = 10_000
# Up to this many rows of every task meet as they are.
FEW = 128
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 24
INLINE_BOUNDS = 32

_TOKEN = re.compile(r"(\d+)(?:\s*[-.]{1,2}\s*(\d+))?")


def parse_skip(expr: str | None) -> list[Range]:
    """``"0, 4-6, 9..11"`` as inclusive ranges; ends in either order, blanks ignored."""
    ranges = []
    for token in (expr or "").split(","):
        token = token.strip()
        if not token:
            continue
        found = _TOKEN.fullmatch(token)
        if not found:
            raise ValueError(f"not a row or a range of rows: {token!r}")
        start = int(found.group(1))
        end = int(found.group(2)) if found.group(2) else start
        ranges.append((min(start, end), max(start, end)))
    return merge_ranges(ranges)


def is_valid_skip(expr: str | None) -> bool:
    try:
        parse_skip(expr)
    except ValueError:
        return False
    return True


def merge_ranges(ranges: Iterable[Range]) -> list[Range]:
    """Sorted ranges without overlaps; neighbours joined."""
    merged: list[Range] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def as_ranges(skip: str | int | Iterable[int] | None) -> list[Range]:
    """Ranges from a skip expression, a count of leading rows, or a list of positions.

    Negative positions are ignored.
    """
    if skip is None:
        return []
    if isinstance(skip, str):
        return parse_skip(skip)
    if isinstance(skip, int):
        return [(0, skip - 1)] if skip > 0 else []
    return merge_ranges((int(i), int(i)) for i in skip if int(i) >= 0)


def is_leading(ranges: Sequence[Range]) -> bool:
    """True when the positions are exactly the first ones, with no gap."""
    return not ranges or (len(ranges) == 1 and ranges[0][0] == 0)


def in_ranges(position: Column, ranges: Sequence[Range]) -> Column:
    """Predicate for a position within the ranges; ranges are never expanded."""
    tests = [position == a if a == b else position.between(a, b) for a, b in ranges]
    return fold(lambda x, y: x | y, tests, F.lit(False))


def _names(order_by: str | Sequence[str]) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by needs at least one column")
    return names


def _unused(df: DataFrame, index: str) -> str:
    if index.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {index!r}; name the position otherwise by index=")
    return index


def head(df: DataFrame, n: int, order_by: str | Sequence[str], index: str = INDEX) -> DataFrame:
    """First ``n`` rows in order, with their positions as ``index``: each task keeps its
    own first ``n``, and only those meet. A name that the table has is refused.

    Above ``FEW`` a pass over the order columns first finds a value that has ``n`` rows up to
    it and less than four times as many (see :func:`head_bound`), so what meets doesn't grow with the number of tasks."""
    index = _unused(df, index)
    if n > HEAD_LIMIT:
        return with_row_index(df, order_by, index=index).where(quoted(index) < n)
    names = _names(order_by)
    order = [quoted(c) for c in names]
    rows = df
    if n > FEW:
        bound = head_bound(df, n, names).scalar()
        rows = df.where(bound.isNull() | (_order_key(df, names) <= bound))
    top = rows.orderBy(*order).limit(n)
    return top.withColumn(index, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def _order_key(df: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(names)])


def head_bound(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """One row, ``bound``: an order value that at least ``n`` rows don't exceed, and fewer than ``4 n``; null if the table may be shorter.

    Each task sorts its order values and tells those at ranks 1, 2, 4, ... up to the first that is ``n`` or more. One of rank ``r`` stands for ``r`` rows up to it, and there are
    fewer than ``2 r`` up to the next. The bound is the first value that ranks up to it stand for ``n`` rows; the last step
    adds ``n`` at most. Under a total order the limits hold for any number of tasks and any spread of rows over them.
    """
    keys = df.select(_order_key(df, _names(order_by)).alias("key")).sortWithinPartitions("key")
    rank = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    ranked = keys.select("key", rank.alias("rank")).where((F.col("rank") < 2 * n) & (F.col("rank").bitwiseAND(F.col("rank") - 1) == 0))
    stands = F.when(F.col("rank") == 1, 1).otherwise(F.col("rank") / 2).cast("long")
    so_far = F.sum(stands).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.select("key", so_far.alias("rows")).where(F.col("rows") >= n).agg(F.min("key").alias("bound"))


def skip_rows(df: DataFrame, skip: str | int | Iterable[int] | None, order_by: str | Sequence[str]) -> DataFrame:
    """Drop the rows at the given positions.

    Skipped rows almost always lie at the head. Their order values then come from a
    top-k and leave by a broadcast anti join of at most ``HEAD_LIMIT`` rows, so the
    table itself is neither sorted nor shuffled.
    """
    ranges = as_ranges(skip)
    if not ranges:
        return df
    names = _names(order_by)
    last = ranges[-1][1]
    if last >= HEAD_LIMIT:
        place = free_name(df, "__position")
        return with_row_index(df, names, index=place).where(~in_ranges(quoted(place), ranges)).drop(place)
    keys = df.select(*[quoted(c) for c in names])
    place = free_name(keys, "__position")
    dropped = head(keys, last + 1, names, place).where(in_ranges(quoted(place), ranges))
    dropped = dropped.select(*[quoted(c).alias(f"__skip{i}") for i, c in enumerate(names)])
    same = [quoted(c).eqNullSafe(F.col(f"__skip{i}")) for i, c in enumerate(names)]
    return df.join(F.broadcast(dropped), fold(lambda x, y: x & y, same), "left_anti")


def with_row_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
    index: str = INDEX,
) -> DataFrame:
    """Add ``index``: the 0-based position of each row under a total order. A name that
    the table has is refused.

    Two small passes over the order columns alone come first: a sample for the range
    bounds and a count per range. The bounds and the running counts go into the plan
    as literals, so the table moves once, to sort within its ranges.
    """
    names, index = _names(order_by), _unused(df, index)
    order = [quoted(c) for c in names]
    keys = df.select(*order)
    rows = keys.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(rows / rows_per_range)))
    if ranges == 1:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
        return df.withColumn(index, place.cast("long"))
    bounds = _range_bounds(keys, names, rows, ranges)
    number = _range_number(F.struct(*order), bounds, keys.schema)
    counts = dict(keys.groupBy(number.alias("r")).count().collect())
    offsets, total = [], 0
    for r in range(len(bounds) + 1):
        offsets.append(total)
        total += counts.get(r, 0)
    part = free_name(df, "__range")
    numbered = df.withColumn(part, number)
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    base = F.get(F.lit(offsets).cast("array<bigint>"), F.col(part))
    return numbered.withColumn(index, base + place).drop(part)


def _range_bounds(keys: DataFrame, names: list[str], rows: int, ranges: int) -> list[tuple]:
    # At most ranges * 2 * SAMPLES_PER_RANGE order tuples reach the driver, whatever the table size.
    fraction = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    sample = keys.sample(fraction=fraction, seed=11)
    sample = sample.orderBy(F.xxhash64(*sample.columns)).limit(2 * ranges * SAMPLES_PER_RANGE)
    ordered = sample.orderBy(*[quoted(c) for c in names]).collect()
    picks = sorted({len(ordered) * i // ranges for i in range(1, ranges)}) if ordered else []
    return list(dict.fromkeys(tuple(ordered[p]) for p in picks))


def _range_number(value: Column, bounds: list[tuple], schema: T.StructType) -> Column:
    """How many bounds are not above the value.

    Few bounds become nested conditions, which run as generated code; more become a
    binary search over a constant array, so that the plan stays small.
    """
    if len(bounds) <= INLINE_BOUNDS:
        rows = [
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema, strict=True)])
            for row in bounds
        ]
        return _search_tree(value, rows, 0, len(rows))
    table = _constant_rows(bounds, schema)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.reduce(
        F.lit(steps).cast("array<int>"),
        F.lit(0),
        lambda found, step: F.when(F.get(table, found + step - 1) <= value, found + step).otherwise(found),
    )


def _constant_rows(rows: list[tuple], schema: T.StructType) -> Column:
    # As JSON the rows are one literal to build; the planner folds it to a constant.
    # Sorting after parsing keeps the search right should a value come back rounded.
    def shown(v):
        if isinstance(v, (bytes, bytearray)):
            return base64.b64encode(v).decode()
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    text = json.dumps([dict(zip(schema.names, row, strict=True)) for row in rows], default=shown)
    return F.sort_array(F.from_json(F.lit(text), T.ArrayType(schema)))


def _search_tree(value: Column, bounds: list[Column], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high + 1) // 2
    return F.when(value >= bounds[middle - 1], _search_tree(value, bounds, middle, high)).otherwise(
        _search_tree(value, bounds, low, middle - 1)
    )
