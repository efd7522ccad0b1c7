"""A whole reshaping run as one lazy plan: read, skip, deduplicate, map, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridweave.operators.dedupe import DEFAULT_CONCAT_SEPARATOR, Dedupe, dedupe_and_map
from gridweave.operators.mapping import Slot, as_slots, check_sources
from gridweave.operators.positions import skip_rows
from gridweave.sources.csv import FILE_ORDER
from gridweave.sources.tables import RunMetrics, open_table, processed_path, split_source, write_table


@dataclass(frozen=True)
class ReshapeJob:
    """What to read, which rows to skip, how to deduplicate, what to write.

    ``source`` is a path, ``path::sheet`` or a DataFrame. ``skip`` counts the physical
    rows of a file, the header among them; for a DataFrame it counts rows under
    ``order_by``. Files bring their own row order, so ``order_by`` may stay unset there.
    """

    source: str | DataFrame
    mapping: Sequence[Slot] = ()
    skip: str | int | Sequence[int] | None = None
    dedupe: Dedupe | None = None
    order_by: str | Sequence[str] | None = None
    strict: bool = False
    strict_per_slot: bool = False
    options: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(spec: Mapping[str, Any], **settings) -> ReshapeJob:
        """A job from a plain dict ``{source, mapping, skip_rows, dedupe}``."""
        chosen = spec.get("dedupe") or {}
        dedupe = Dedupe(
            key=chosen.get("key") or None,
            strategy=chosen.get("strategy") or "drop",
            separator=chosen.get("concat_sep") or DEFAULT_CONCAT_SEPARATOR,
            enabled=bool(chosen.get("enabled")),
        )
        return ReshapeJob(
            source=spec.get("source"),
            mapping=tuple(as_slots(spec.get("mapping") or ())),
            skip=spec.get("skip_rows") or None,
            dedupe=dedupe,
            **settings,
        )

    def rows(self, spark: SparkSession) -> tuple[DataFrame, str | Sequence[str] | None]:
        """The rows to work on, and the columns that order them."""
        if isinstance(self.source, DataFrame):
            if self.skip and self.order_by is None:
                raise ValueError("skipping rows of a DataFrame needs order_by")
            return (skip_rows(self.source, self.skip, self.order_by) if self.skip else self.source), self.order_by
        from_file = self.order_by is None and _has_lines(self.source)
        options = dict(self.options)
        if from_file:
            options["with_order"] = True
        if self.skip and _has_lines(self.source):
            options["skip"] = self.skip
        df = open_table(spark, self.source, **options)
        if self.skip and not _has_lines(self.source):
            if self.order_by is None:
                raise ValueError("skipping rows of this format needs order_by")
            df = skip_rows(df, self.skip, self.order_by)
        return df, FILE_ORDER if from_file else self.order_by

    def plan(self, spark: SparkSession) -> DataFrame:
        """The result, not run yet."""
        slots = as_slots(self.mapping)
        if not self.source or not slots:
            raise ValueError("nothing to do: the source or the mapping is missing")
        df, order = self.rows(spark)
        check_sources(df, slots, self.strict, self.strict_per_slot)
        return dedupe_and_map(df, slots, self.dedupe, order)

    def run(self, spark: SparkSession, output: str | None = None) -> tuple[str, RunMetrics]:
        """Write the result; by default beside the input, as ``<stem>_processed<suffix>``."""
        if output is None:
            if isinstance(self.source, DataFrame):
                raise ValueError("a DataFrame source needs an output path")
            output = processed_path(split_source(self.source)[0])
        return output, write_table(self.plan(spark), output, sep=self.options.get("sep", ","))


def _has_lines(source: str) -> bool:
    return split_source(source)[0].lower().endswith((".csv", ".xlsx"))
