"""Text rendering and text normalisation as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's idea of white space that Java's Unicode \s leaves out.
PY_SPACE = r"[\s\x1c-\x1f]"
# Java flags that give Python regex meaning: Unicode classes, and only "\n" ends a line.
PY_FLAGS = "(?Ud)"


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots, blanks or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def fold_nan(col: Column, dtype: T.DataType) -> Column:
    """NaN counts as null everywhere in this library."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def _float_text(col: Column) -> Column:
    # Below 1e7 the JVM and Python write a number alike; up to 1e16 the JVM's exponent is
    # written out. The rare rest stands in a lambda, which stays out of the generated code: with it inlined, a handful of
    # columns make a method too large for the JVM to compile.
    size = F.abs(col)
    rest = F.transform(F.array(col), _rare_float_text)
    alike = ((size >= 1e-3) & (size < 1e7)) | (size == 0)
    digits = F.rtrim(col.cast("string").cast("decimal(38,20)").cast("string"), F.lit("0"))
    large = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return (
        F.when(alike, col.cast("string"))
        .when((size >= 1e7) & (size < 1e16), large)
        .otherwise(F.get(rest, F.lit(0)))
    )


def _rare_float_text(x: Column) -> Column:
    """Python has a plain number from 1e-4 to 1e16, and 1e-05, 1.5e+20 outside.

    (JVMs before 19 show one digit too many for some values, mostly from 1e16 on.)
    """
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("string").cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    signed = F.replace(F.regexp_replace(x.cast("string"), r"(\.0)?E(\d)", "e+$2"), F.lit("E"), F.lit("e"))
    scientific = F.regexp_replace(F.replace(signed, F.lit(".0e"), F.lit("e")), r"([+-])(\d)$", "$10$2")
    return (
        F.when((size >= 1e-4) & (size < 1e16), plain)
        .when(F.isnan(x), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .otherwise(scientific)
    )


def py_str(col: Column, dtype: T.DataType) -> Column:
    """Text of a value the way Python's ``str`` shows it; null and NaN stay null."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _float_text(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.DateType, T.NullType)):
        return col.cast("string")
    raise TypeError(f"a {dtype.simpleString()} column has no text form; flatten it first")


def column_text(df: DataFrame, name: str) -> Column:
    return py_str(quoted(name), column_type(df, name))


def normalize_text(col: Column) -> Column:
    """Lower case without surrounding white space; null becomes ``""``."""
    trimmed = F.regexp_replace(F.lower(col), f"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")
    return F.coalesce(trimmed, F.lit(""))


def normalize_text_list(col: Column) -> Column:
    """:func:`normalize_text` for every non-null entry of an array."""
    return F.transform(F.filter(col, lambda s: s.isNotNull()), lambda s: normalize_text(s))
