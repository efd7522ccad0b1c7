"""Layouts: a target table's column names, its extra header rows and its footer rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.text import column_text

SECTION, SECTION_ROW = "section", "section_row"
HEADER, BODY, FOOTER = 0, 1, 2


def _rows(value: Sequence | None) -> tuple[tuple[str, ...], ...]:
    """One row of names, or several rows of names, as rows."""
    if not value:
        return ()
    if all(isinstance(v, str) for v in value):
        return (tuple(value),)
    return tuple((row,) if isinstance(row, str) else tuple(row) for row in value)


@dataclass(frozen=True)
class Layout:
    """The last header row names the columns; the rows above it and the footer are content."""

    header: tuple[tuple[str, ...], ...] = ()
    body: tuple[str, ...] = ()
    footer: tuple[tuple[str, ...], ...] = ()
    components: tuple[str, ...] = ()
    file_interface: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(spec: Mapping[str, Any]) -> Layout:
        """A layout from its JSON form."""
        return Layout(
            header=_rows(spec.get("header")),
            body=tuple(part["columnType"] for part in spec.get("body") or ()),
            footer=_rows(spec.get("footer")),
            components=tuple(spec.get("components") or ()),
            file_interface=spec.get("file_interface"),
            metadata=spec.get("metadata") or {},
        )

    @property
    def columns(self) -> tuple[str, ...]:
        if not self.header:
            raise ValueError("the layout has no header")
        return self.header[-1]


def load_layout(spark: SparkSession, path: str) -> Layout:
    """A layout from a JSON file anywhere Spark can read."""
    return Layout.of(json.loads(spark.read.text(path, wholetext=True).head()[0]))


def apply_layout(df: DataFrame, layout: Layout, sources: Sequence[str]) -> DataFrame:
    """Source columns under the layout's names, in its order. One ``select``."""
    if len(sources) != len(layout.columns):
        raise ValueError(f"the layout has {len(layout.columns)} columns, {len(sources)} sources are given")
    return df.select(*[column_text(df, s).alias(name) for s, name in zip(sources, layout.columns, strict=True)])


def with_sections(body: DataFrame, layout: Layout) -> DataFrame:
    """Body rows with the layout's extra header rows and footer rows, told apart by ``section``.

    ``section`` is 0, 1, 2 for header, body, footer and ``section_row`` the place within
    header or footer (null in the body), so a writer can order by them.
    """
    names = list(layout.columns)
    fixed = [
        (section, place, *[row[i] if i < len(row) else None for i in range(len(names))])
        for section, rows in ((HEADER, layout.header[:-1]), (FOOTER, layout.footer))
        for place, row in enumerate(rows)
    ]
    schema = ", ".join([f"{SECTION} int, {SECTION_ROW} int"] + [f"`{n.replace('`', '``')}` string" for n in names])
    content = body.select(
        F.lit(BODY).alias(SECTION),
        F.lit(None).cast("int").alias(SECTION_ROW),
        *[column_text(body, n).alias(n) for n in names],
    )
    return content.unionByName(body.sparkSession.createDataFrame(fixed, schema)) if fixed else content
