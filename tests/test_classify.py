import pytest
from pyspark.sql import functions as F

from gridweave.operators import (
    DETECTORS,
    ZIP_CODE,
    Detector,
    best_types,
    boolean_check,
    classify,
    column_examples,
    date_check,
    detector_scores,
    length_check,
    length_variance_check,
    match_ratio,
    numeric_check,
    pattern_check,
    predicate_check,
    root_types,
    run_checks,
    run_folded_check,
    string_check,
    uniqueness_check,
    variance_check,
)
from gridweave.operators.detectors import TEXT_TYPE, lineage


@pytest.fixture
def column(spark):
    def make(values, kind="string", name="value"):
        return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")

    return make


def score(df, check):
    row = run_checks(df, df.columns, [check]).head()
    return row.score, row.applies


def scores(df, **options):
    options.setdefault("sample", None)
    return {r.type: r.score for r in detector_scores(classify(df, **options)).collect()}


def test_match_ratio(spark, column):
    tens = column([7 * i for i in range(10)], "int")
    assert tens.agg(match_ratio(F.col("value") >= 42)).head()[0] == 4 / 10
    towns = column(["Oslo", None, "Bergen", "Å", None, "", "Hamar", "Bodø"])
    assert towns.agg(match_ratio(F.col("value").contains("o"))).head()[0] == 2 / 8
    assert towns.limit(0).agg(match_ratio(F.lit(True))).head()[0] == 0.0


def test_date_check(column):
    texts = ["1999-12-05", "05/12/1999", "12/25/1999", "1999-12-05T00:00:01", "5 Dec 1999", "May 17, 1814"]
    assert score(column([*texts, "yesterday", "1999"]), date_check()) == (6 / 8, True)
    more = ["2024-1-5", "31 jan 2024", "JANUARY  3, 2024"]
    assert score(column([*more, "2024-02-30", "24-01-31", " 2024-01-31", "31 January 2024", None]), date_check()) == (
        3 / 8,
        True,
    )
    assert score(column([1, 2], "int"), date_check()) == (0.0, False)


def test_date_check_takes_moments(spark):
    df = spark.sql("SELECT timestamp '2023-05-01' AS value UNION ALL SELECT null")
    assert score(df, date_check()) == (0.5, True)


def test_value_checks(column):
    mixed = column(["1", "abc", None, "12345"])
    assert score(mixed, string_check()) == (0.5, True)
    assert score(mixed, pattern_check(r"\d$", weight=2.0)) == (1.0, True)
    assert score(mixed, length_check(2, 4)) == (0.25, True)
    assert score(mixed, length_check(2)) == (0.5, True)
    assert score(mixed, numeric_check()) == (0.0, False)
    assert score(column(["yes", "No", "1", "x"]), boolean_check()) == (0.375, True)
    assert score(column([None, None]), string_check())[1] is False
    assert score(column([True, False, None], "boolean"), boolean_check())[0] == pytest.approx(1 / 3)


def test_number_checks(column):
    numbers = column([1.0, 2.0, float("nan"), None], "double")
    assert score(numbers, numeric_check()) == (0.25, True)
    assert score(numbers, variance_check(high=0.25)) == (1.0, True)
    assert score(numbers, variance_check(low=0.3)) == (0.0, True)
    assert score(column(["a"]), variance_check()) == (0.0, True)


def test_graded_checks(column):
    assert score(column(["a", "a", None, None]), uniqueness_check(low=0.5)) == (1.0, True)
    assert score(column(["a", "a", "a", None]), uniqueness_check(low=0.6)) == (0.25, True)
    assert score(column(["a", "b"]), uniqueness_check(high=0.9)) == (0.0, True)
    assert score(column(["aa", "bb"]), length_variance_check(high=0.1)) == (1.0, True)
    assert score(column(["a", "bbb"]), length_variance_check(high=0.1)) == (0.0, True)
    assert score(column(["a", "bbb"]), length_variance_check(low=2)) == (0.25, True)
    assert score(column([1, 2], "int"), length_variance_check()) == (0.0, True)


def test_patterns_follow_python_rules(column):
    assert score(column(["12\n", "12\r", "१२"]), pattern_check(r"^\d{2}$"))[0] == pytest.approx(2 / 3)


def test_checks_without_uniqueness_shuffle_no_values(spark, column):
    plan = run_checks(column(["a"]), ["value"], [string_check(), length_check(1)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in text and text.count("Exchange hashpartitioning") == 1


def test_boolean_texts(column):
    found = scores(column(["YES", "no", "No", None, "yes"], name="paid"))
    assert found["boolean"] > 0
    assert scores(column(["maybe", "2"]), detectors=[DETECTORS[1]]) == {}


def test_no_cell_is_shuffled(column):
    plan = classify(column(["a", "b", None]), ["value"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("shown" in line for line in exchanges)


def test_distinct_values_by_hash(spark, column):
    from gridweave.operators.checks import column_cells, distinct_counts

    df = spark.sql("SELECT CAST(id % 7 AS STRING) AS a, IF(id % 3 = 0, NULL, id) AS b, CAST(NULL AS INT) AS c, '' AS d FROM range(3000)")
    found = {r[0]: r[1] for r in distinct_counts(column_cells(df, df.columns)).collect()}
    assert found == {"a": 7, "b": 2001, "c": 1, "d": 1}


def test_worked_country_codes(column):
    found = scores(column(["SE", "NO", "DK"] * 5, name="country"))
    assert found["text"] == pytest.approx(0.75544, abs=1e-5)
    assert found["countrycode"] == pytest.approx(0.96429, abs=1e-5)
    best = best_types(classify(column(["SE", "NO"], name="country"), sample=None)).head()
    assert best.type == "countrycode"


def test_codes(column):
    numbers = [f"{i:02d}-{i:03d}-{i:04d}" for i in range(40)] + ["123456789"]
    assert max(scores(column(numbers, name="id")), key=scores(column(numbers, name="id")).get) in ("duns", "companyname")
    assert "zipcode" not in scores(column(["12345"]))
    assert "zipcode" in scores(column(["12345", "12346-0001"]), detectors=[*DETECTORS, ZIP_CODE])


def test_empty_and_null_columns(column):
    assert scores(column([None, None])) == {}
    nothing = best_types(classify(column([None]), sample=None)).head()
    assert nothing.type is None and nothing.score is None


def test_tie_goes_to_the_deeper_type(spark):
    rows = [("x", [("numeric", 0.8, 0, 1), ("duns", 0.8, 1, 2), ("text", 0.1, 0, 3)])]
    schema = "column_name string, candidates array<struct<type:string,score:double,depth:int,rank:int>>"
    classified = spark.createDataFrame(rows, schema)
    assert best_types(classified).head().type == "duns"
    assert root_types(classified).head().root == "numeric"


def test_threshold(spark):
    schema = "column_name string, candidates array<struct<type:string,score:double,depth:int,rank:int>>"
    low = spark.createDataFrame([("x", [("boolean", 0.05, 0, 1)]), ("y", [])], schema)
    assert {r.type for r in best_types(low).collect()} == {None}
    assert {r.type for r in best_types(low, threshold=0.01).collect()} == {"boolean", None}


def test_detectors_of_ones_own(column):
    shout = TEXT_TYPE.child("shout", [predicate_check("loud", lambda c: c.text == F.upper(c.text), weight=2.0)])
    louder = shout.child("louder", [pattern_check("!$", weight=2.0)])
    detectors = [TEXT_TYPE, shout, louder]
    assert lineage(detectors, "louder") == ["louder", "shout", "text"]
    found = scores(column(["A!", "B!"]), detectors=detectors)
    alone = scores(column(["A!", "B!"]), detectors=[Detector("text", TEXT_TYPE.checks)])
    assert found["louder"] > found["shout"] > found["text"] == alone["text"]


def test_sample_takes_the_head(spark):
    df = spark.range(300).select(
        "id", F.when(F.col("id") < 100, "SE").otherwise("not a code").alias("country")
    )
    best = best_types(classify(df.repartition(5), ["country"], sample=100, order_by="id")).head()
    assert best.type == "countrycode"
    with pytest.raises(ValueError, match="order_by"):
        classify(df, sample=100)


def test_examples(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, " ", "b", "a", "\t", "c", "d"])], "i int, v string")
    found = dict(rows(column_examples(df.repartition(3), "i")))
    assert found["v"] == ["b", "a", "c"] and found["i"] == ["0", "1", "2"]


def test_long_texts_do_not_exhaust_the_matcher(column):
    found = scores(column(["word " * 40_000, "x1 " * 40_000]))
    assert "text" in found


def test_folded_check_with_tasks_without_rows(spark):
    def count(state, values):
        return merge(state or b"0 0", b"%d %d" % (sum(v is not None for v in values), len(values)))

    def merge(a, b):
        return b"%d %d" % tuple(x + y for x, y in zip(map(int, a.split()), map(int, b.split()), strict=True))

    def share(state):
        filled, total = map(int, state.split())
        return filled / total

    rows = spark.createDataFrame([("a",), (None,), ("b",), ("c",)], "v string").repartition(7)
    assert run_folded_check(rows, ["v"], "filled", count, merge, share, weight=1.0).collect() == [("v", "filled", 0.75)]


def test_folded_query_on_splits_and_nulls(spark, tmp_path):
    from catalogue.queries import QUERIES

    spark.createDataFrame([(1, "a"), (22, None), (3, "bb")], "o_orderkey long, o_orderpriority string").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["check_folded_function"](spark, str(tmp_path)).collect()
    assert sorted((r["column_name"], r["score"]) for r in found) == [("o_orderkey", 0.666667), ("o_orderpriority", 0.333333)]
