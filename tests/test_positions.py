import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import (
    column_sample,
    head,
    is_valid_skip,
    parse_skip,
    preview,
    skip_rows,
    with_row_index,
)
from gridweave.operators.positions import HEAD_LIMIT, as_ranges, is_leading, merge_ranges


def expand(ranges):
    return [i for a, b in ranges for i in range(a, b + 1)]


def test_skip_expression():
    assert parse_skip("") == [] and parse_skip(None) == []
    assert expand(parse_skip("0, 2, 4")) == [0, 2, 4]
    assert expand(parse_skip("5-2")) == [2, 3, 4, 5]
    assert expand(parse_skip("1..3, 7, 10-11")) == [1, 2, 3, 7, 10, 11]
    assert expand(parse_skip("4.6,8--9")) == [4, 5, 6, 8, 9]
    assert expand(parse_skip("3,1,2,3,2")) == [1, 2, 3]
    for bad in ("a,b", "1-2-3", "-1", "1 2"):
        assert not is_valid_skip(bad)
        with pytest.raises(ValueError):
            parse_skip(bad)


def test_long_ranges_are_not_expanded():
    assert parse_skip("0-999999999999") == [(0, 999999999999)]
    assert merge_ranges([(5, 7), (1, 2), (3, 4), (6, 9)]) == [(1, 9)]


def test_leading_and_lists():
    assert is_leading(as_ranges([2, 0, 1])) and is_leading([]) and is_leading(as_ranges([0]))
    assert not is_leading(as_ranges([0, 2])) and not is_leading(as_ranges([1, 2, 3]))
    assert as_ranges([-1, 3]) == [(3, 3)] and as_ranges(2) == [(0, 1)] and as_ranges(0) == []


@pytest.mark.parametrize("order", [["v", "id"], ["id"], ["t", "v", "id"]])
@pytest.mark.parametrize("per_range", [7, 40, 1000])
def test_row_index_against_sorting(spark, order, per_range):
    random.seed(per_range)
    # One value of v holds a third of the rows; order columns hold nulls.
    data = [(i, random.choice([None, 5, 5, *range(9)]), random.choice(["b", None, "a", "A"])) for i in range(600)]
    df = spark.createDataFrame(random.sample(data, 600), "id int, v int, t string").repartition(7)
    found = {r.id: r.idx for r in with_row_index(df, order, rows_per_range=per_range).collect()}
    places = [("id", "v", "t").index(c) for c in order]
    ranked = sorted(data, key=lambda r: [(r[p] is not None, r[p]) for p in places])
    assert found == {row[0]: i for i, row in enumerate(ranked)}


def test_row_index_types(spark):
    df = spark.range(500).select(
        "id",
        (F.col("id") / 7).alias("d"),
        F.timestamp_seconds(F.col("id") * 3).alias("ts"),
        (F.col("id") / 4).cast("decimal(10,2)").alias("m"),
    )
    df = df.withColumn("day", F.to_date("ts")).withColumn("raw", F.lpad("id", 5, "0").cast("binary"))
    for order in (["d"], ["ts"], ["m"], ["raw"], ["day", "m"]):
        for per_range in (50, 6):
            assert with_row_index(df.repartition(5), order, rows_per_range=per_range).where("idx != id").count() == 0


def test_many_ranges_stay_a_small_plan(spark):
    plan = with_row_index(spark.range(3000), "id", rows_per_range=3)
    assert plan.where("idx != id").count() == 0
    assert "from_json" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_row_index_of_nothing(spark):
    assert with_row_index(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("skip", ["0, 4-6, 9..11", [0], 3, "0-99", "5,12000", None, "20000"])
def test_skip_rows(spark, skip):
    size = HEAD_LIMIT + 5000
    df = spark.range(size).repartition(6)
    kept = {r.id for r in skip_rows(df, skip, "id").collect()}
    assert kept == set(range(size)) - set(expand(as_ranges(skip)))


def test_skip_near_the_head_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 AS b").write.parquet(str(tmp_path / "t"))
    plan = skip_rows(spark.read.parquet(str(tmp_path / "t")), "0-3", "id")._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in plan.toString() and "hashpartitioning" not in plan.toString()


def test_head_and_preview(spark, rows):
    df = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("n")).repartition(5)
    assert rows(head(df, 3, "id")) == [(0, "n0", 0), (1, "n1", 1), (2, "n2", 2)]
    assert rows(preview(df, [["id", "n"]], "id")) == [(f"{i} n{i}",) for i in range(5)]


def test_column_sample(spark, rows):
    df = spark.createDataFrame([(i, 10 + i) for i in range(5)], "A int, B int").repartition(3)
    assert rows(column_sample(df, 2, "A")) == [("A", 0, "0"), ("A", 1, "1"), ("B", 0, "10"), ("B", 1, "11")]
    chunked = column_sample(df, 1, "A", columns=["B"], chunk=2)
    assert rows(chunked) == [("B", 0, "10"), ("B", 2, "12"), ("B", 4, "14")]


@pytest.mark.parametrize("spread", ["id % 1000", "least(id, 999)", "greatest(0, id - 50000) % 1000"])
def test_few_rows_meet_for_a_head(spark, spread):
    """A thousand tasks: the rows up to the bound are at least as many as asked for, and less than four times as many."""
    from gridweave.operators.positions import head_bound

    df = spark.range(60_000).selectExpr("hash(id) AS h", "id", f"{spread} AS part").repartitionByRange(1000, "part").drop("part")
    for n in (129, 1000, 9000):
        bound = head_bound(df, n, ["h", "id"]).first()["bound"]
        below = df.where((F.col("h") < bound[0]) | ((F.col("h") == bound[0]) & (F.col("id") <= bound[1]))).count()
        assert n <= below < 4 * n
    first = [r["id"] for r in df.orderBy("h", "id").limit(500).collect()]
    found = {r["idx"]: r["id"] for r in head(df, 500, ["h", "id"]).collect()}
    assert [found[i] for i in range(500)] == first


def test_a_short_table_has_no_bound(spark):
    df = spark.createDataFrame([(None, 1), (2.5, 0), (float("nan"), 3)], "a double, b int")
    assert [tuple(r)[1:] for r in head(df, 5000, ["a", "b"]).collect()] == [(1, 0), (0, 1), (3, 2)]


def test_columns_named_like_a_position_stay(spark, rows):
    df = spark.createDataFrame([(i, (i + 1) * 100) for i in range(20)], "id int, idx int").repartition(3)
    assert rows(skip_rows(df, "0", "idx")) == sorted([(i, (i + 1) * 100) for i in range(1, 20)], key=repr)
    far = spark.range(HEAD_LIMIT + 3).selectExpr("id", "id * 2 AS idx")
    kept = skip_rows(far, f"1,{HEAD_LIMIT + 1}", "id")
    assert kept.columns == ["id", "idx"] and kept.where("idx <> 2 * id").count() == 0 and kept.count() == HEAD_LIMIT + 1
    assert rows(preview(df, [["idx"]], "id", n=2)) == [("100",), ("200",)]
    assert rows(column_sample(df, 1, "id", columns=["idx"])) == [("idx", 0, "100")]
    for add in (head, with_row_index):
        with pytest.raises(ValueError):
            add(df, *([3] if add is head else []), "id")
    assert rows(with_row_index(df, "id", index="place").where("place <> id")) == []
