"""Deduplication by key: keep the first row, or merge the distinct values.

"First" is decided by ``order_by``, which must be a total order over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import column_text, column_type, fold_nan, quoted
from gridweave.operators.mapping import SlotLike, apply_mapping, as_slots, used_sources

STRATEGIES = ("drop", "concat")
DEFAULT_CONCAT_SEPARATOR = "; "
_LONG_NAMES = ("column_name", "value", "first_seen")


@dataclass(frozen=True)
class Dedupe:
    """Deduplication options."""

    key: str | None = None
    strategy: str = "drop"
    separator: str = DEFAULT_CONCAT_SEPARATOR
    enabled: bool = True

    def settle(self, columns: Sequence[str]) -> Dedupe:
        """Apply the defaults; switch off when the key is unset or not a column."""
        strategy = (self.strategy or "drop").lower()
        return Dedupe(
            key=self.key,
            strategy=strategy if strategy in STRATEGIES else "drop",
            separator=self.separator or DEFAULT_CONCAT_SEPARATOR,
            enabled=bool(self.enabled and self.key and self.key in columns),
        )


def order_value(order_by: str | Sequence[str]) -> Column:
    """The order columns as one comparable value.

    A single column stays bare: ``min`` over a plain number is a hash aggregate in
    generated code, while ``min`` over a struct needs a sort.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by needs at least one column")
    return quoted(names[0]) if len(names) == 1 else F.struct(*[quoted(n) for n in names])


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that have a key; NaN counts as no key."""
    folded = fold_nan(quoted(key), column_type(df, key))
    return df.where(folded.isNotNull())


def keep_first(df: DataFrame, key: str, columns: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """First row per key, as a whole row with its nulls: ``key`` plus ``columns``.

    ``min_by`` combines on the map side, so each task ships at most one row per key
    and a key that holds a third of the table is no heavier than any other.
    """
    others = [c for c in dict.fromkeys(columns) if c != key]
    keyed = with_key(df, key)
    if not others:
        return keyed.select(quoted(key)).distinct()
    first = F.min_by(F.struct(*[quoted(c) for c in others]), order_value(order_by)).alias("__first")
    grouped = keyed.groupBy(quoted(key)).agg(first)
    return grouped.select(quoted(key), *[F.col("__first").getField(c).alias(c) for c in others])


def distinct_values(
    df: DataFrame, key: str, columns: Sequence[str], order_by: str | Sequence[str], key_as: str | None = None
) -> DataFrame:
    """Long form of the merge: ``(key, column_name, value, first_seen)``.

    The key column keeps its name; one called like another column of the result needs ``key_as``.

    One row per distinct non-blank text per key and column, with the order value at
    which it first appears, plus one null-value row per key and column that has a
    blank. Grouping by the value as well spreads a hot key over all tasks, so this
    form is whole at any group size.
    """
    name = key_as or key
    if name.lower() in _LONG_NAMES:
        raise ValueError(f"the result has a column {name!r} of its own; name the key by key_as=")
    return _distinct(df, key, columns, order_by).withColumnRenamed("__key", name)


def _distinct(df: DataFrame, key: str, columns: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    others = [c for c in dict.fromkeys(columns) if c != key]
    blanked = with_key(df, key).select(
        quoted(key).alias("__key"),
        order_value(order_by).alias("__order"),
        *[F.nullif(column_text(df, c), F.lit("")).alias(c) for c in others],
    )
    values = blanked.unpivot(["__key", "__order"], [quoted(c) for c in others], "column_name", "value")
    return values.groupBy("__key", "column_name", "value").agg(F.min("__order").alias("first_seen"))


def merge_values(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: str | Sequence[str],
    separator: str = DEFAULT_CONCAT_SEPARATOR,
    max_cell_bytes: int | None = None,
) -> DataFrame:
    """One row per key; every other column holds its distinct texts in first-seen order.

    Duplicates are gone before anything is collected. What remains for a key is the
    content of its output cells, and one cell is one value of one row. With
    ``max_cell_bytes`` a larger cell raises before its values meet in one task;
    :func:`distinct_values` gives the same content as rows.
    """
    others = [c for c in dict.fromkeys(columns) if c != key]
    if not others:
        return with_key(df, key).select(quoted(key)).distinct()
    values = _distinct(df, key, others, order_by)
    if max_cell_bytes is not None:
        values = _bounded(values, len(separator.encode()), max_cell_bytes)
    lists = [
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.when(
                            (F.col("column_name") == c) & F.col("value").isNotNull(),
                            F.struct("first_seen", "value"),
                        )
                    )
                ),
                lambda s: s["value"],
            ),
            separator,
        ).alias(c)
        for c in others
    ]
    return values.groupBy("__key").agg(*lists).withColumnRenamed("__key", key)


def _bounded(values: DataFrame, gap: int, limit: int) -> DataFrame:
    # The size of the largest cell is one value: a scalar subquery over the same grouped
    # rows (it shares their exchange), built from sums that combine on the map side.
    sizes = values.groupBy(F.col("__key").alias("key"), "column_name").agg(
        F.sum(F.octet_length("value") + F.lit(gap)).alias("bytes"),
        F.min("first_seen").alias("first_seen"),
    )
    largest = sizes.agg(F.max_by(F.struct("bytes", "key", "column_name", "first_seen"), "bytes")).scalar()
    error = F.raise_error(
        F.concat(
            F.lit(f"a merged cell may pass {limit} bytes, key, column and first row: "),
            F.to_json(largest),
            F.lit("; distinct_values holds keys of any size"),
        )
    ).cast("string")
    fits = F.coalesce(largest.getField("bytes") <= limit, F.lit(True))
    return values.withColumn("value", F.when(fits, F.col("value")).otherwise(error))


def exclude_seen(df: DataFrame, key: str, seen: DataFrame, seen_key: str | None = None) -> DataFrame:
    """Rows whose key is not among the keys already seen.

    Each seen key meets the rows once: a key seen very often is reduced in the tasks that read it.
    """
    old = seen.select(quoted(seen_key or key).alias("__seen")).distinct()
    return df.join(old, quoted(key) == F.col("__seen"), "left_anti")


def dedupe_increment(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: str | Sequence[str],
    seen: DataFrame,
    seen_key: str | None = None,
) -> DataFrame:
    """First row per key of an increment, for keys not seen before.

    Reducing to one row per key first keeps hot keys out of the join.
    """
    return exclude_seen(keep_first(df, key, columns, order_by), key, seen, seen_key)


def dedupe_and_map(
    df: DataFrame,
    mapping: str | Iterable[SlotLike],
    dedupe: Dedupe | None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Deduplicate on the columns the mapping needs, then map once."""
    slots = as_slots(mapping)
    settled = dedupe.settle(df.columns) if dedupe else None
    if not settled or not settled.enabled:
        return apply_mapping(df, slots)
    if order_by is None:
        raise ValueError("deduplication needs order_by: a DataFrame has no row order of its own")
    present = set(df.columns)
    needed = [s for s in used_sources(slots) if s in present]
    if settled.strategy == "concat":
        reduced = merge_values(df, settled.key, needed, order_by, settled.separator)
    else:
        reduced = keep_first(df, settled.key, needed, order_by)
    return apply_mapping(reduced, slots)
