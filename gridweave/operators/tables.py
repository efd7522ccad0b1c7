"""Whole-table operators: append, row count, validation, schema report."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.text import column_text, column_type, quoted

# Names a value type is reported under.
INTEGER, DECIMAL, TRUTH, MOMENT, TEXT = "int64", "float64", "bool", "datetime64[ns]", "object"

_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
_TRUTH_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def append_rows(df: DataFrame, more: DataFrame | Sequence[Mapping]) -> DataFrame:
    """Rows of both, columns matched by name, gaps null."""
    if not isinstance(more, DataFrame):
        if not more:
            return df
        more = df.sparkSession.createDataFrame([dict(row) for row in more])
    return df.unionByName(more, allowMissingColumns=True)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def validate_columns(columns: Sequence[str | None]) -> None:
    """Raise for an empty or a repeated column name."""
    if any(not c for c in columns):
        raise ValueError("a column has an empty name")
    repeated = sorted(c for c, n in Counter(columns).items() if n > 1)
    if repeated:
        raise ValueError(f"repeated column names: {repeated}")


# One bit per class of text; a column's classes are the bits of its values, or-ed.
_IS_INTEGER, _IS_DECIMAL, _IS_TRUTH, _IS_TEXT = 1, 2, 4, 8


def _text_class(col: Column) -> Column:
    whole = F.when(col.try_cast("bigint").isNotNull(), _IS_INTEGER).otherwise(_IS_TEXT)
    return (
        F.when(col.isNull(), F.lit(None).cast("int"))
        .when(col.rlike(_INTEGER_TEXT), whole)
        .when(col.rlike(_DECIMAL_TEXT), _IS_DECIMAL)
        .when(col.isin(_TRUTH_WORDS), _IS_TRUTH)
        .otherwise(_IS_TEXT)
    )


def _reported_type(dtype: T.DataType, rows: Column, present: Column, classes: Column) -> Column:
    gaps = rows > present
    if isinstance(dtype, T.StringType):
        return (
            F.when(rows == 0, TEXT)
            .when((present == 0) | (classes == _IS_DECIMAL) | (classes == _IS_DECIMAL + _IS_INTEGER), DECIMAL)
            .when(classes == _IS_INTEGER, F.when(gaps, DECIMAL).otherwise(INTEGER))
            .when((classes == _IS_TRUTH) & ~gaps, TRUTH)
            .otherwise(TEXT)
        )
    if isinstance(dtype, T.IntegralType):
        return F.when(gaps, DECIMAL).otherwise(INTEGER)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.lit(DECIMAL)
    if isinstance(dtype, T.BooleanType):
        return F.when(gaps, TEXT).otherwise(TRUTH)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(MOMENT)
    raise TypeError(f"a {dtype.simpleString()} column has no reported type")


def schema_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(position, column_name, dtype)`` with the type the column's values have.

    Text columns are judged by all their values, in one aggregate over all columns.
    """
    chosen = list(columns or df.columns)
    types = [column_type(df, c) for c in chosen]
    found = []
    for i, (c, dtype) in enumerate(zip(chosen, types, strict=True)):
        found.append(F.count(quoted(c)).alias(f"present{i}"))
        if isinstance(dtype, T.StringType):
            found.append(F.bit_or(_text_class(quoted(c))).alias(f"classes{i}"))
        else:
            found.append(F.lit(0).alias(f"classes{i}"))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *found)
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            _reported_type(t, F.col("rows"), F.col(f"present{i}"), F.col(f"classes{i}")).alias("dtype"),
        )
        for i, (c, t) in enumerate(zip(chosen, types, strict=True))
    ]
    return totals.select(F.inline(F.array(*lines)))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the type all their values have (one pass to find out)."""
    texts = [c for c in df.columns if isinstance(column_type(df, c), T.StringType)]
    if not texts:
        return df
    found = {r["column_name"]: r["dtype"] for r in schema_report(df, texts).collect()}
    spark_types = {INTEGER: "bigint", DECIMAL: "double", TRUTH: "boolean"}
    casts = []
    for c in df.columns:
        target = spark_types.get(found.get(c, TEXT))
        col = quoted(c)
        casts.append(F.trim(col).try_cast(target).alias(c) if target else col)
    return df.select(*casts)


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as text; nulls stay null."""
    return df.select(*[column_text(df, c).alias(c) for c in df.columns])
