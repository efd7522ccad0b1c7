import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridweave.operators import (
    Dedupe,
    dedupe_and_map,
    dedupe_increment,
    distinct_values,
    keep_first,
    merge_values,
)

DROP_ROWS = [(0, "oak", "tall", 30), (1, "elm", None, 9), (2, "elm", "ill", 8), (3, "fir", "green", 41), (4, "oak", "old", 2)]
CONCAT_ROWS = [(0, "k1", "x", "p"), (1, "k1", "y", "p"), (2, "k2", "y", "q"), (3, "k1", "x", None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_keep_first(spark, rows, parts):
    random.seed(parts)
    df = spark.createDataFrame(random.sample(DROP_ROWS, 5), "idx bigint, A string, B string, C int").repartition(parts)
    out = dedupe_and_map(df, "A, B", Dedupe(key="A"), order_by="idx")
    assert rows(out) == [("elm", ""), ("fir", "green"), ("oak", "tall")]


@pytest.mark.parametrize("parts", [1, 7])
def test_concat(spark, rows, parts):
    random.seed(parts)
    df = spark.createDataFrame(random.sample(CONCAT_ROWS, 4), "idx bigint, A string, B string, C string")
    dedupe = Dedupe(key="A", strategy="concat", separator=",")
    out = dedupe_and_map(df.repartition(parts), "A, B, C", dedupe, order_by="idx")
    assert rows(out) == [("k1", "x,y", "p"), ("k2", "y", "q")]


def test_first_row_wins_with_its_nulls(spark, rows):
    df = spark.createDataFrame([(0, "k", None), (1, "k", "v")], "idx int, A string, B string")
    assert rows(keep_first(df, "A", ["B"], "idx")) == [("k", None)]


def test_no_key_and_unknown_key_keep_all(spark, rows):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "A string, B int")
    for key in (None, "missing"):
        assert rows(dedupe_and_map(df, "A, B", Dedupe(key=key))) == [("x", "1"), ("x", "2")]


def test_null_and_nan_keys_are_dropped(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, float("nan"), "b")], "idx int, K double, V string")
    for strategy in ("drop", "concat"):
        out = dedupe_and_map(df, "K", Dedupe(key="K", strategy=strategy), order_by="idx")
        assert out.columns == ["K"] and out.count() == 0


def test_key_only_concat_gives_a_row_per_key(spark, rows):
    df = spark.createDataFrame([(0, 1, "a"), (1, 1, "b")], "idx int, K int, V string")
    assert rows(dedupe_and_map(df, "K", Dedupe(key="K", strategy="concat"), order_by="idx")) == [("1",)]


def test_defaults():
    settled = Dedupe(key="A", strategy="other", separator="").settle(["A"])
    assert (settled.strategy, settled.separator, settled.enabled) == ("drop", "; ", True)


def test_order_is_required(spark):
    df = spark.createDataFrame([("x",)], "A string")
    with pytest.raises(ValueError, match="order_by"):
        dedupe_and_map(df, "A", Dedupe(key="A"))


def brute(data, key, columns):
    """Plain loops over rows in order: first rows, and distinct texts per key."""
    first, merged = {}, {}
    for row in sorted(data):
        k = row[key]
        if k is None:
            continue
        first.setdefault(k, row)
        lists = merged.setdefault(k, {c: [] for c in columns})
        for c in columns:
            if row[c] not in (None, "") and row[c] not in lists[c]:
                lists[c].append(row[c])
    return first, merged


def test_hot_key_against_brute_force(spark, rows):
    random.seed(9)
    data = [
        (
            i,
            "hot" if random.random() < 0.4 else random.choice([None, *map(str, range(40))]),
            random.choice([None, "", *map(str, range(300))]),
            random.choice("abc"),
        )
        for i in range(4000)
    ]
    df = spark.createDataFrame(random.sample(data, len(data)), "idx int, K string, B string, C string").repartition(7)
    first, merged = brute(data, 1, [2, 3])
    assert rows(keep_first(df, "K", ["B", "C"], "idx")) == sorted(((k, r[2], r[3]) for k, r in first.items()), key=repr)
    expected = sorted(((k, "; ".join(m[2]), "; ".join(m[3])) for k, m in merged.items()), key=repr)
    assert rows(merge_values(df, "K", ["B", "C"], "idx")) == expected
    assert rows(merge_values(df, "K", ["B", "C"], ["C", "idx"], max_cell_bytes=None).select("K")) == sorted(
        ((k,) for k in merged), key=repr
    )
    long = distinct_values(df, "K", ["B"], "idx").where("value is not null")
    assert long.count() == sum(len(m[2]) for m in merged.values())


def test_cell_size_is_checked(spark):
    df = spark.range(100).select(F.lit("k").alias("K"), F.col("id").alias("idx"), F.col("id").cast("string").alias("V"))
    with pytest.raises(PySparkException, match="may pass 50 bytes"):
        merge_values(df, "K", ["V"], "idx", max_cell_bytes=50).collect()
    assert distinct_values(df, "K", ["V"], "idx").count() == 100


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("K"), "id", F.col("id").cast("string").alias("V"))
    plan = keep_first(df, "K", ["V"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_increment(spark, rows):
    new = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "b", 3)], "idx int, K string, V int")
    seen = spark.createDataFrame([("a",), ("z",)], "old string")
    assert rows(dedupe_increment(new, "K", ["V"], "idx", seen, "old")) == [("b", 2)]


def test_key_called_like_a_column_of_the_long_form(spark, rows):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "x")], "n int, value string, v string")
    assert rows(merge_values(df, "value", ["v"], "n")) == [("a", "x; y"), ("b", "x")]
    with pytest.raises(ValueError):
        distinct_values(df, "value", ["v"], "n")
    assert distinct_values(df, "value", ["v"], "n", key_as="k").columns == ["k", "column_name", "value", "first_seen"]


def test_size_limit_is_per_cell(spark, rows):
    df = spark.createDataFrame([(0, "a", "x" * 60, "y" * 60)], "n int, k string, p string, q string")
    assert rows(merge_values(df, "k", ["p", "q"], "n", max_cell_bytes=100)) == [("a", "x" * 60, "y" * 60)]


def test_seen_keys_are_reduced_before_the_join(spark):
    seen = spark.createDataFrame([("a",)] * 9 + [("b",)], "old string")
    new = spark.createDataFrame([(0, "a", 1), (1, "c", 2)], "n int, K string, V int")
    out = dedupe_increment(new, "K", ["V"], "n", seen, "old")
    assert [r.K for r in out.collect()] == ["c"]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[1]
