"""Semantic column types: the checks, keywords and parent of each detector."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.operators.checks import (
    Check,
    Measured,
    alpha_check,
    boolean_check,
    length_check,
    length_variance_check,
    numeric_check,
    pattern_check,
    string_check,
    uniqueness_check,
    variance_check,
)

Gate = Callable[[Measured], Column]


def always(m: Measured) -> Column:
    return F.lit(True)


def mostly_text(m: Measured) -> Column:
    """More than a tenth of the values are texts."""
    return (m("total") > 0) & (m("texts") / F.greatest(m("total"), F.lit(1)) > 0.1)


def some_number(m: Measured) -> Column:
    """A number, or a text of digits only, occurs."""
    return (m("numbers") > 0) | (m("digit_texts") > 0)


@dataclass(frozen=True)
class Detector:
    """One semantic type. ``checks`` holds the parent's checks as well."""

    name: str
    checks: tuple[Check, ...]
    parent: str | None = None
    keywords: tuple[str, ...] = ()
    gate: Gate = always

    def with_check(self, check: Check) -> Detector:
        return replace(self, checks=(*self.checks, check))

    def child(self, name: str, checks: Sequence[Check], keywords: Sequence[str] = ()) -> Detector:
        """A more specific type: inherits the checks and the gate."""
        return Detector(name, (*self.checks, *checks), self.name, tuple(keywords), self.gate)


TEXT_TYPE = Detector("text", (string_check(0.5),), gate=mostly_text)
NUMERIC_TYPE = Detector("numeric", (numeric_check(0.5),), gate=some_number)


# Shared, so that each is scored once per column.
_EVEN_LENGTH = {spread: length_variance_check(high=spread, weight=1.1) for spread in (0.1, 0.01)}
_MOSTLY_UNIQUE = uniqueness_check(low=0.8)


def _number_like(name: str, patterns: Sequence[tuple[str, float]], spread: float = 0.1) -> Detector:
    """A code written in one shape: patterns, nearly even length, nearly all different."""
    shapes = [pattern_check(p, weight=w, name=f"{name}_pattern_{i}") for i, (p, w) in enumerate(patterns)]
    return NUMERIC_TYPE.child(name, [*shapes, _EVEN_LENGTH[spread], _MOSTLY_UNIQUE])


def _word_like(name: str, pattern: str, weight: float, low: int, high: int, length_weight: float, keywords) -> Detector:
    """A text in one alphabet within a length."""
    return TEXT_TYPE.child(
        name,
        [
            pattern_check(pattern, weight=weight, name=f"{name}_pattern"),
            length_check(low, high, weight=length_weight, name=f"{name}_length"),
        ],
        keywords,
    )


# Type names, patterns, weights, bounds and keywords. The order is the
# order in which equal scores are ranked.
DETECTORS = (
    TEXT_TYPE,
    Detector("boolean", (boolean_check(0.5),)),
    NUMERIC_TYPE,
    Detector("name", (alpha_check(1.0), length_check(3, 50, name="name_length")), keywords=("name",)),
    _word_like("companyname", r"^[A-Za-z0-9\s&.,-]+$", 1.5, 3, 100, 1.0, ("company", "business", "organization")),
    _number_like("duns", [(r"^\d{9}$", 1.0), (r"^\d{2}-\d{3}-\d{4}$", 1.6)]),
    _word_like("countrycode", r"^[A-Z]{2}$", 2.0, 2, 2, 1.5, ("country", "iso")),
    NUMERIC_TYPE.child("numericalcategory", [variance_check(high=0.2), uniqueness_check(high=0.1)]),
    _word_like("textcategory", r"^[A-Za-z\s]+$", 1.5, 3, 50, 1.0, ("category", "type", "classification")),
    _word_like("countryname", r"^[A-Za-z\s-]+$", 1.5, 3, 50, 1.0, ("country", "nation", "state")),
    _word_like("currencycode", r"^[A-Z]{3}$", 2.0, 3, 3, 1.5, ("currency", "iso4217")),
    _number_like(
        "phonenumber",
        [(r"^(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{4}$", 0.75)],
    ),
    _number_like(
        "nordicregistrationnumber",
        [(r"^(?:\d{7}-\d|\d{8}|\d{9}|\d{10}|(16|[2-9]\d)\d{6}-?\d{4})$", 0.5)],
    ),
    _number_like("swedishregistrationnumber", [(r"^(16)?\d{6}(-)?\d{4}$", 1.0)]),
    _number_like("norwegianregistrationnumber", [(r"^\d{9}$", 0.75)]),
    _number_like("danishregistrationnumber", [(r"^\d{8}$", 0.75)], spread=0.01),
    _number_like("finnishregistrationnumber", [(r"^\d{7}-\d$", 1.0)], spread=0.01),
)

# Known, but not part of the default set.
ZIP_CODE = _number_like("zipcode", [(r"^\d{5}(-\d{4})?$", 1.0), (r"^\d{5}$", 1.2)])


def lineage(detectors: Sequence[Detector], name: str) -> list[str]:
    """The type and its ancestors, nearest first."""
    parents = {d.name: d.parent for d in detectors}
    line = [name]
    while parents.get(line[-1]):
        line.append(parents[line[-1]])
    return line
