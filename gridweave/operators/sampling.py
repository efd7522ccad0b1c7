"""Column samples and the mapped preview."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import column_text, free_name, quoted
from gridweave.operators.mapping import SlotLike, apply_mapping
from gridweave.operators.positions import INDEX, ROWS_PER_RANGE, head, with_row_index

PREVIEW_ROWS = 5
SAMPLE_CHUNK = 1_000


def unpivot_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows ``(*keep, column_name, value)`` with every value as text."""
    texts = df.select(
        *[quoted(k).alias(f"__keep{i}") for i, k in enumerate(keep)],
        *[column_text(df, c).alias(c) for c in columns],
    )
    kept = [F.col(f"__keep{i}") for i in range(len(keep))]
    rows = texts.unpivot(kept, [quoted(c) for c in columns], "column_name", value)
    return rows.withColumnsRenamed({f"__keep{i}": k for i, k in enumerate(keep)}) if keep else rows


def column_sample(
    df: DataFrame,
    n: int,
    order_by: str | Sequence[str],
    columns: Sequence[str] | None = None,
    chunk: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """First ``n`` values of each column as ``(column_name, idx, value)``.

    With ``chunk`` set: the first ``n`` values of every run of ``chunk`` rows.
    """
    chosen = list(columns or df.columns)
    place = free_name(df, "__position")
    if chunk:
        rows = with_row_index(df, order_by, rows_per_range, place).where(quoted(place) % chunk < n)
    else:
        rows = head(df, n, order_by, place)
    return unpivot_text(rows, chosen, [place]).select("column_name", quoted(place).alias(INDEX), "value")


def preview(
    df: DataFrame,
    mapping: str | Iterable[SlotLike],
    order_by: str | Sequence[str],
    n: int = PREVIEW_ROWS,
) -> DataFrame:
    """The first ``n`` rows, mapped."""
    return apply_mapping(head(df, n, order_by, free_name(df, "__position")), mapping)
