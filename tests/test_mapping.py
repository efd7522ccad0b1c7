import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions import py_str
from gridweave.operators import (
    Slot,
    apply_mapping,
    as_slots,
    missing_columns,
    missing_report,
    output_columns,
    used_sources,
)
from gridweave.operators.mapping import slot_of


def test_single_and_combined(spark, rows):
    df = spark.createDataFrame([("Rex", "dog", 4), (None, "cat", None), ("Ada", None, 11)], "pet string, kind string, age int")
    slots = [{"sources": ["kind", "age", "pet"], "separator": ": "}, {"sources": ["pet"], "separator": "unused"}]
    out = apply_mapping(df, slots)
    assert out.columns == ["Combined_1", "pet"]
    assert rows(out) == [(": 11: Ada", "Ada"), ("cat: : ", ""), ("dog: 4: Rex", "Rex")]


def test_null_keeps_its_place(spark):
    df = spark.createDataFrame([("a", None, float("nan"))], "A string, B int, C double")
    assert apply_mapping(df, [Slot(("A", "B", "C"), "-")]).head()[0] == "a--"


def test_separator_defaults_and_legacy_text(spark):
    df = spark.createDataFrame([("a", "b")], "A string, B string")
    assert apply_mapping(df, [{"sources": ["A", "B"]}]).head()[0] == "a b"
    assert apply_mapping(df, [{"sources": ["A", "B"], "separator": ""}]).head()[0] == "a b"
    assert as_slots("A, B ,,") == [Slot(("A",)), Slot(("B",))]


def test_name_clash_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", "b")], "A string, Combined_2 string")
    out = apply_mapping(df, [["A"], ["A", "Combined_2"], ["A"], ["Combined_2"]])
    assert out.columns == ["A", "Combined_2"]
    assert tuple(out.head()) == ("a", "b")
    assert output_columns([["A"], ["A", "Combined_2"], ["A"]]) == ["A", "Combined_2"]


def test_empty_slot_and_empty_mapping(spark):
    df = spark.createDataFrame([("a",)], "A string")
    assert apply_mapping(df, [[]]).head().asDict() == {"Combined_1": ""}
    with pytest.raises(ValueError):
        apply_mapping(df, [])


def test_missing_columns(spark, rows):
    df = spark.createDataFrame([("x",)], "A string")
    slots = [{"sources": ["A", "B"], "separator": "-"}, {"sources": ["C"]}]
    assert apply_mapping(df, slots).head()[0] == "x-"
    assert missing_columns(df, slots) == [(0, ["B"]), (1, ["C"])]
    assert rows(missing_report(df, slots)) == [(0, "B"), (1, "C")]
    with pytest.raises(ValueError, match="missing columns"):
        apply_mapping(df, slots, strict=True)
    with pytest.raises(ValueError, match="slots"):
        apply_mapping(df, slots, strict_per_slot=True)


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([("a", "b")], "`x.y` string, `q``r` string")
    assert apply_mapping(df, [["x.y"], ["q`r"]]).columns == ["x.y", "q`r"]


def test_used_sources():
    assert used_sources([["B", "A"], ["A", "C"]]) == ["B", "A", "C"]
    assert slot_of(["A", "B", "A"]).sources == ("A", "B")


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([([1],)], "A array<int>")
    with pytest.raises(TypeError):
        apply_mapping(df, [["A"]])


def test_float_text_matches_python(spark):
    random.seed(4)
    values = [1.5, 1e7, 12345678.5, 1e15, 1e16, 1.5e20, 1e-4, 9.9e-5, -2.5e8, 0.0, -0.0, 1e100, 1e-7, float("-inf")]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-6, 12) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = df.select("v", py_str(F.col("v"), T.DoubleType()).alias("s")).collect()
    assert all(str(r.v) == r.s for r in shown)


def test_other_types_as_text(spark):
    df = spark.sql("SELECT true a, date '2024-01-02' b, timestamp_ntz '2024-01-02 03:04:05.120' c, 1.50BD d, null e")
    out = apply_mapping(df, [[c] for c in "abcde"]).head()
    assert tuple(out) == ("True", "2024-01-02", "2024-01-02 03:04:05.120000", "1.50", "")


def test_mapping_is_one_projection(spark):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c"))
    plan = apply_mapping(df, [["id"], ["b", "c"]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
