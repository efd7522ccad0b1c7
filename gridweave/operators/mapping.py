"""Column mapping: each output column is one source column, or several joined as text.

Every operator here is one ``select``; nothing shuffles and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import column_text

DEFAULT_SEPARATOR = " "


@dataclass(frozen=True)
class Slot:
    """One output column: the source columns it joins, and the text between them."""

    sources: tuple[str, ...] = ()
    separator: str = DEFAULT_SEPARATOR

    def output_name(self, position: int) -> str:
        return self.sources[0] if len(self.sources) == 1 else f"Combined_{position + 1}"


SlotLike = Slot | Mapping | Sequence[str]


def as_slots(mapping: str | Iterable[SlotLike]) -> list[Slot]:
    """Slots from a list of ``Slot`` / ``{"sources", "separator"}``, or from ``"A, B"``.

    The text form gives one single-source slot per name.
    """
    if isinstance(mapping, str):
        return [Slot((name.strip(),)) for name in mapping.split(",") if name.strip()]
    slots = []
    for entry in mapping:
        if isinstance(entry, Slot):
            slots.append(Slot(tuple(entry.sources), entry.separator or DEFAULT_SEPARATOR))
        elif isinstance(entry, Mapping):
            slots.append(Slot(tuple(entry.get("sources") or ()), entry.get("separator") or DEFAULT_SEPARATOR))
        else:
            slots.append(Slot(tuple(entry)))
    return slots


def slot_of(sources: Iterable[str], separator: str | None = None) -> Slot:
    """A slot that lists each source once, at its first place."""
    return Slot(tuple(dict.fromkeys(sources)), separator or DEFAULT_SEPARATOR)


def used_sources(mapping: str | Iterable[SlotLike]) -> list[str]:
    """Distinct source names in order of first use."""
    return list(dict.fromkeys(s for slot in as_slots(mapping) for s in slot.sources if s))


def output_columns(mapping: str | Iterable[SlotLike]) -> list[str]:
    """Output names; a repeated name keeps its first place."""
    return list(dict.fromkeys(slot.output_name(i) for i, slot in enumerate(as_slots(mapping))))


def missing_columns(df: DataFrame, mapping: str | Iterable[SlotLike]) -> list[tuple[int, list[str]]]:
    """``(slot position, sorted missing sources)`` for every slot that misses a column."""
    present = set(df.columns)
    report = []
    for position, slot in enumerate(as_slots(mapping)):
        missing = sorted({s for s in slot.sources if s and s not in present})
        if missing:
            report.append((position, missing))
    return report


def missing_report(df: DataFrame, mapping: str | Iterable[SlotLike]) -> DataFrame:
    """:func:`missing_columns` as a DataFrame ``(slot int, missing string)``."""
    rows = [(slot, name) for slot, names in missing_columns(df, mapping) for name in names]
    return df.sparkSession.createDataFrame(rows, "slot int, missing string")


def check_sources(df: DataFrame, mapping: str | Iterable[SlotLike], strict: bool, strict_per_slot: bool) -> None:
    """Raise for missing sources; runs on the schema alone, before any plan is built."""
    report = missing_columns(df, mapping)
    if strict_per_slot and report:
        raise ValueError(f"mapping slots miss columns: {report}")
    if strict and report:
        raise ValueError(f"missing columns: {sorted({name for _, names in report for name in names})}")


def combine(df: DataFrame, sources: Sequence[str], separator: str = DEFAULT_SEPARATOR) -> Column:
    """Sources as one text. A null, NaN or absent column keeps its place as ``""``."""
    present = set(df.columns)
    parts = [F.coalesce(column_text(df, s), F.lit("")) if s in present else F.lit("") for s in sources]
    if not parts:
        return F.lit("")
    joined = [parts[0]]
    for part in parts[1:]:
        joined += [F.lit(separator), part]
    return F.concat(*joined) if len(joined) > 1 else joined[0]


def apply_mapping(
    df: DataFrame,
    mapping: str | Iterable[SlotLike],
    *,
    strict: bool = False,
    strict_per_slot: bool = False,
) -> DataFrame:
    """One text column per slot, in slot order.

    When two slots share an output name the later one gives the value and the
    earlier one the place. Missing sources read as ``""`` unless a strict flag is set.
    """
    slots = as_slots(mapping)
    if not slots:
        raise ValueError("the mapping has no slots")
    check_sources(df, slots, strict, strict_per_slot)
    outputs: dict[str, Column] = {}
    for position, slot in enumerate(slots):
        outputs[slot.output_name(position)] = combine(df, slot.sources, slot.separator)
    return df.select(*[col.alias(name) for name, col in outputs.items()])
