"""Column checks: a weighted score of how well a column's values meet a rule.

A check names the aggregates it needs over the cells of a column, one row per value, and a
formula over them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.dates import parse_date_text
from gridweave.functions.text import PY_FLAGS, PY_SPACE, column_type, fold_nan, free_name, quoted
from gridweave.operators.positions import head, with_row_index
from gridweave.operators.sampling import unpivot_text

# Texts that read as a truth value.
TRUTH_WORDS = ["true", "false", "1", "0", "yes", "no"]

TEXT, NUMBER, MOMENT, OTHER = "text", "number", "moment", "other"


def kind_of(dtype: T.DataType) -> str:
    """What the values of a Spark type count as. Truth values count as numbers."""
    if isinstance(dtype, T.StringType):
        return TEXT
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return NUMBER
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return MOMENT
    return OTHER


def as_number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        col = col.cast("int")
    return fold_nan(col.cast("double"), T.DoubleType())


@dataclass(frozen=True)
class Kinds:
    """Which columns hold texts, numbers and moments, as tests on ``column_name``."""

    text: Column
    number: Column
    moment: Column

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str]) -> Kinds:
        kinds = {c: kind_of(column_type(df, c)) for c in columns}

        def test(kind: str) -> Column:
            named = [c for c in columns if kinds[c] == kind]
            return F.lit(len(named) > 0) if len(named) in (0, len(columns)) else F.col("column_name").isin(named)

        return Kinds(test(TEXT), test(NUMBER), test(MOMENT))


class Cells:
    """Cells of a column, one row each, with the text they show."""

    def __init__(self, shown: Column, kinds: Kinds):
        self.shown = shown
        self.text = F.when(kinds.text, shown)
        self.is_number = kinds.number & shown.isNotNull()
        self.is_moment = kinds.moment & shown.isNotNull()

    def count(self, test: Column | None = None) -> Column:
        return F.count(F.lit(1)) if test is None else F.count_if(test)

    def length_variance(self) -> Column:
        return F.var_pop(F.length(self.text))


Measure = Callable[[Cells], Column]
Measured = Callable[[str], Column]

BASE_MEASURES: dict[str, Measure] = {
    "total": lambda c: c.count(),
    "texts": lambda c: c.count(c.text.isNotNull()),
    "numbers": lambda c: c.count(c.is_number),
    "moments": lambda c: c.count(c.is_moment),
    "present": lambda c: c.count(c.shown.isNotNull()),
    "length_variance": lambda c: c.length_variance(),
    "digit_texts": lambda c: c.count(c.text.rlike(f"{PY_FLAGS}^{PY_SPACE}*\\d+{PY_SPACE}*\\z")),
}


@dataclass(frozen=True, eq=False)
class Check:
    """``score`` times ``weight``; ``applies`` says whether the check takes part at all."""

    name: str
    weight: float
    score: Callable[[Measured], Column]
    applies: Callable[[Measured], Column] = field(default=lambda m: m("total") > 0)
    measures: dict[str, Measure] = field(default_factory=dict)
    of_numbers: bool = False
    of_distinct: bool = False

    def weighted(self, m: Measured) -> Column:
        return self.score(m) * F.lit(float(self.weight))


def _share(m: Measured, part: str) -> Column:
    return F.when(m("total") > 0, m(part) / m("total")).otherwise(F.lit(0.0))


def match_ratio(test: Column) -> Column:
    """Share of rows that pass, nulls among all rows; 0 for no rows."""
    return F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0))


def predicate_check(name: str, test: Callable[[Cells], Column], weight: float = 0.5) -> Check:
    """Share of cells that pass a test; the way to add a check of one's own."""
    return Check(name, weight, lambda m: _share(m, name), measures={name: lambda c: c.count(test(c))})


def string_check(weight: float = 0.5) -> Check:
    """1 when all values present are text, 0.25 when some are, else 0."""
    return Check(
        "string_check",
        weight,
        lambda m: F.when(m("texts") == m("present"), 1.0).when(m("texts") > 0, 0.25).otherwise(0.0),
        lambda m: m("texts") > 0,
    )


def numeric_check(weight: float = 0.5) -> Check:
    """Share of numbers."""
    return Check("numeric_check", weight, lambda m: _share(m, "numbers"), lambda m: m("numbers") > 0)


def variance_check(low: float = 0.0, high: float = math.inf, weight: float = 1.0) -> Check:
    """1 when the population variance of the numbers lies within the bounds."""
    return Check(
        "variance_check",
        weight,
        lambda m: F.when(m("number_variance").between(float(low), float(high)), 1.0).otherwise(0.0),
        of_numbers=True,
    )


def pattern_check(pattern: str, weight: float = 1.0, name: str = "pattern_check") -> Check:
    """Share of texts in which the regex is found."""
    measure = f"pattern {pattern}"
    return Check(
        name,
        weight,
        lambda m: _share(m, measure),
        measures={measure: lambda c: c.count(c.text.rlike(PY_FLAGS + pattern))},
    )


def length_check(low: int = 0, high: int | None = None, weight: float = 1.0, name: str = "length_check") -> Check:
    """Share of texts whose length lies within the bounds."""
    measure = f"length {low} {high}"

    def fits(c: Cells) -> Column:
        size = F.length(c.text)
        return size >= low if high is None else size.between(low, high)

    return Check(name, weight, lambda m: _share(m, measure), measures={measure: lambda c: c.count(fits(c))})


def _graded(value: Column, low: float, high: float | None) -> Column:
    """0 above the upper bound, 1 from the lower bound on, 0.25 below it."""
    grade = F.when(value >= float(low), 1.0).otherwise(0.25)
    return grade if high is None else F.when(value > float(high), 0.0).otherwise(grade)


def length_variance_check(low: float = 0.0, high: float | None = None, weight: float = 1.0) -> Check:
    """Graded population variance of the text lengths; 0 without texts."""
    return Check(
        "length_variance_check",
        weight,
        lambda m: F.when(m("texts") > 0, _graded(m("length_variance"), low, high)).otherwise(0.0),
    )


def uniqueness_check(low: float = 0.0, high: float | None = None, weight: float = 1.0) -> Check:
    """Graded share of distinct values, null counting as one value."""
    return Check(
        "uniqueness_check",
        weight,
        lambda m: F.when(m("total") > 0, _graded(m("distinct") / m("total"), low, high)).otherwise(0.0),
        of_distinct=True,
    )


def date_check(weight: float = 1.0) -> Check:
    """Share of values that are dates, or texts in one of the known date layouts."""
    return Check(
        "date_check",
        weight,
        lambda m: _share(m, "dates"),
        lambda m: m("texts") + m("moments") > 0,
        {"dates": lambda c: c.count(c.is_moment | parse_date_text(c.text).isNotNull())},
    )


def boolean_check(weight: float = 0.5) -> Check:
    """Share of values that show as a truth word."""
    return predicate_check("boolean_check", lambda c: F.lower(c.shown).isin(TRUTH_WORDS), weight)


def alpha_check(weight: float = 1.0) -> Check:
    """Share of texts made of letters and white space only."""
    # One character class, not alternatives: Java recurses once per character through those.
    pattern = f"{PY_FLAGS}^[\\p{{L}}\\s\\x1c-\\x1f]*+\\z"
    return predicate_check("name_alpha_check", lambda c: c.text.rlike(pattern), weight)


def column_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, shown)`` for every cell of the columns; NaN shows as null."""
    return unpivot_text(df, columns, value="shown")


def number_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """``(number_column, number_variance)`` per column of numbers; None when there is none.

    Variance is taken from the typed values in one pass without a shuffle of cells: sums
    of squares over texts or counted values would lose digits.
    """
    numbers = [(c, column_type(df, c)) for c in columns if kind_of(column_type(df, c)) == NUMBER]
    if not numbers:
        return None
    wide = df.agg(*[F.var_pop(as_number(quoted(c), t)).alias(f"v{i}") for i, (c, t) in enumerate(numbers)])
    lines = [
        F.struct(F.lit(c).alias("number_column"), F.col(f"v{i}").alias("number_variance"))
        for i, (c, _) in enumerate(numbers)
    ]
    return wide.select(F.inline(F.array(*lines)))


def distinct_counts(rows: DataFrame) -> DataFrame:
    """``(counted_column, n_distinct)`` of cells ``(column_name, shown)``; null counts as one value.

    Values are told apart by 128 bits of hash, two longs, so no text is shuffled: tasks drop repeated ones, all tasks
    share a column's values, and what is left of a column is a count per task.
    """
    digest = [F.xxhash64("shown").alias("h"), F.xxhash64(F.lit(1), "shown").alias("g")]
    values = rows.select(F.col("column_name").alias("counted_column"), *digest, F.col("shown").isNull().alias("none")).distinct()
    return values.groupBy("counted_column").agg(F.count(F.lit(1)).alias("n_distinct"))


def measured_columns(
    df: DataFrame, columns: Sequence[str], checks: Sequence[Check], rows: DataFrame, cells: Cells
) -> tuple[DataFrame, Measured]:
    """One row per column with every measure the checks need; the second part names them.

    Tests run in the tasks that read the cells, and a row of counts per column leaves each.
    """
    wanted = {**BASE_MEASURES}
    for check in checks:
        wanted.update(check.measures)
    aliases = {name: f"m{i}" for i, name in enumerate(wanted)}
    measured = rows.groupBy("column_name").agg(*[measure(cells).alias(aliases[n]) for n, measure in wanted.items()])
    found = {name: F.col(alias) for name, alias in aliases.items()}
    found["number_variance"] = F.lit(None).cast("double")
    variances = number_variances(df, columns) if any(c.of_numbers for c in checks) else None
    if variances is not None:
        # One row per column of the table.
        measured = measured.join(F.broadcast(variances), F.col("column_name") == F.col("number_column"), "left")
        found["number_variance"] = F.col("number_variance")
    if any(c.of_distinct for c in checks):
        # One row per column here as well.
        counts = distinct_counts(rows)
        measured = measured.join(F.broadcast(counts), F.col("column_name") == F.col("counted_column"), "left")
        found["distinct"] = F.col("n_distinct")
    return measured, found.__getitem__


def run_checks(df: DataFrame, columns: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """``(column_name, check_name, applies, score)`` for every column and check, in one job.

    Aggregates that no score refers to are pruned. What is shuffled is one row per column and task, and for a uniqueness check
    16 bytes of hash per distinct value.
    """
    cells = Cells(F.col("shown"), Kinds.of(df, columns))
    measured, m = measured_columns(df, columns, checks, column_cells(df, columns), cells)
    lines = [
        F.struct(
            F.lit(check.name).alias("check_name"),
            check.applies(m).alias("applies"),
            check.weighted(m).cast("double").alias("score"),
        )
        for check in checks
    ]
    return measured.select("column_name", F.inline(F.array(*lines)))


def run_list_check(
    df: DataFrame,
    columns: Sequence[str],
    name: str,
    score: Callable[[list[str | None]], float],
    order_by: str | Sequence[str],
    *,
    weight: float = 0.5,
    sample: int | None = None,
) -> DataFrame:
    """``(column_name, check_name, score)`` of a Python function over a list of values.

    The way out for a rule that no expression can state. The function sees the texts of
    all rows in order, so a column's values have to fit one task; ``sample`` names a number of leading
    rows to see instead, and :func:`run_folded_check` needs no list.
    """
    place = free_name(df, "__position")

    def judge(cells: pd.DataFrame) -> pd.DataFrame:
        ordered = cells.sort_values("place", kind="stable")
        values = [None if pd.isna(v) else v for v in ordered["value"]]
        return pd.DataFrame([(ordered["column_name"].iloc[0], name, float(score(values)) * weight)])

    if sample is None:
        rows = with_row_index(df, order_by, index=place)
    else:
        rows = head(df, sample, order_by, place)
    cells = unpivot_text(rows, columns, [place]).select("column_name", quoted(place).alias("place"), "value")
    return cells.groupBy("column_name").applyInPandas(judge, "column_name string, check_name string, score double")


def run_folded_check(
    df: DataFrame,
    columns: Sequence[str],
    name: str,
    fold: Callable[[bytes | None, list[str | None]], bytes],
    merge: Callable[[bytes, bytes], bytes],
    score: Callable[[bytes], float],
    *,
    weight: float = 0.5,
) -> DataFrame:
    """``(column_name, check_name, score)`` of a rule that goes through the values once, in no order.

    ``fold`` takes some values into a state, a task at a time; ``merge`` joins two states. A state
    per column and task is all that meets, whatever the number of rows.
    """

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, bytes] = {}
        for cells in batches:
            for column, values in cells.groupby("column_name")["value"]:
                states[column] = fold(states.get(column), [None if pd.isna(v) else v for v in values])
        if states:  # a task may have no rows
            yield pd.DataFrame({"column_name": list(states), "state": list(states.values())})

    def judge(states: pd.DataFrame) -> pd.DataFrame:
        whole = functools.reduce(merge, states["state"])
        return pd.DataFrame([(states["column_name"].iloc[0], name, float(score(whole)) * weight)])

    states = unpivot_text(df, columns).mapInPandas(folded, "column_name string, state binary")
    return states.groupBy("column_name").applyInPandas(judge, "column_name string, check_name string, score double")
