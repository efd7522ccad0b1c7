import json

import pytest
from pyspark.sql import functions as F

from gridweave.functions import normalize_number, normalize_number_list, normalize_text, normalize_text_list
from gridweave.operators import (
    Dedupe,
    Layout,
    append_rows,
    apply_layout,
    load_layout,
    row_count,
    schema_report,
    validate_columns,
    with_sections,
)
from gridweave.plans import ReshapeJob
from gridweave.sources import open_table
from gridweave.streaming import BatchLog, dedupe_stream, observed, read_first_rows, write_first_rows


def test_append(spark, rows):
    df = spark.createDataFrame([(1, "a")], "k bigint, v string")
    more = append_rows(df, [{"v": "b", "k": 2}])
    assert rows(append_rows(more, spark.createDataFrame([(3, 1.5)], "k bigint, w double"))) == [
        (1, "a", None),
        (2, "b", None),
        (3, None, 1.5),
    ]
    assert row_count(more).head()[0] == 2


def test_validate():
    validate_columns(["a", "b"])
    for bad in (["a", "", "c"], ["a", None], ["A", "A"]):
        with pytest.raises(ValueError):
            validate_columns(bad)


def test_schema_report(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "True", "x", 1, True), ("2", None, "2", "false", "1", None, False)],
        "i string, g string, f string, b string, t string, n int, o boolean",
    )
    found = {r.column_name: r.dtype for r in schema_report(df).collect()}
    assert found == {
        "i": "int64", "g": "float64", "f": "float64", "b": "bool", "t": "object", "n": "float64", "o": "bool"
    }


def test_normalisers(spark):
    df = spark.createDataFrame(
        [(0.0, "\tÆble KAGE ", [2.5, 0.0, None, -3.0, 7.0, float("nan")], [None, "Ø ", " x Y"])],
        "x double, s string, xs array<double>, ss array<string>",
    )
    row = df.select(
        normalize_number(F.col("x")).alias("x"),
        normalize_number(F.lit(2)).alias("two"),
        normalize_text(F.col("s")).alias("s"),
        normalize_text(F.lit(None).cast("string")).alias("none"),
        normalize_number_list(F.col("xs")).alias("xs"),
        normalize_text_list(F.col("ss")).alias("ss"),
    ).head()
    assert row.x == 0.0 and abs(row.two - 0.9) < 1e-12 and row.s == "æble kage" and row.none == ""
    assert len(row.xs) == 3 and sorted(row.xs)[0] == 0.0 and 0 < row.xs[0] < row.xs[2] < 1
    assert row.ss == ["ø", "x y"]


def test_layout(spark, tmp_path, rows):
    spec = {
        "components": ["header", "body", "footer"],
        "header": [["List", ""], ["name", "number"]],
        "body": [{"columnType": "companyname"}, {"columnType": "number"}],
        "footer": ["total"],
        "file_interface": "csv",
        "metadata": {"encoding": "utf-8"},
    }
    (tmp_path / "layout.json").write_text(json.dumps(spec, indent=1))
    layout = load_layout(spark, str(tmp_path / "layout.json"))
    assert layout.columns == ("name", "number") and layout.body == ("companyname", "number")
    df = spark.createDataFrame([(7, "x")], "k int, n string")
    body = apply_layout(df, layout, ["n", "k"])
    assert body.columns == ["name", "number"] and rows(body) == [("x", "7")]
    assert rows(with_sections(body, layout)) == [(0, 0, "List", ""), (1, None, "x", "7"), (2, 0, "total", None)]
    assert Layout.of({"header": ["a", "b"]}).columns == ("a", "b")
    with pytest.raises(ValueError):
        apply_layout(df, layout, ["n"])


def test_job_on_files(spark, tmp_path, rows):
    (tmp_path / "in.csv").write_text("title\nA,B\nk1,x\nk2,y\nk1,z\nk1,x\n")
    spec = {
        "source": str(tmp_path / "in.csv"),
        "mapping": [{"sources": ["A"]}, {"sources": ["A", "B"], "separator": "-"}],
        "skip_rows": [0],
        "dedupe": {"enabled": True, "key": "A", "strategy": "concat", "concat_sep": ","},
    }
    output, metrics = ReshapeJob.of(spec).run(spark)
    assert output == str(tmp_path / "in_processed.csv") and metrics.rows == 2
    assert rows(open_table(spark, output)) == [("k1", "k1-x,z"), ("k2", "k2-y")]
    plain = ReshapeJob.of({**spec, "dedupe": {}}).plan(spark)
    assert plain.count() == 4


def test_job_on_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, f"k{i % 3}", f"v{i}") for i in range(9)], "idx int, K string, V string")
    job = ReshapeJob(df, mapping=[["K"], ["V"]], skip="0", dedupe=Dedupe(key="K"), order_by="idx")
    assert rows(job.plan(spark)) == [("k0", "v3"), ("k1", "v1"), ("k2", "v2")]
    df.write.parquet(str(tmp_path / "t.parquet"))
    same = ReshapeJob(str(tmp_path / "t.parquet"), [["K"]], skip=8, order_by="idx")
    assert rows(same.plan(spark)) == [("k2",)]


def test_job_refuses(spark):
    df = spark.createDataFrame([(1,)], "A int")
    with pytest.raises(ValueError, match="nothing to do"):
        ReshapeJob(df, []).plan(spark)
    with pytest.raises(ValueError, match="missing columns"):
        ReshapeJob(df, [["B"]], strict=True).plan(spark)
    with pytest.raises(ValueError, match=r"\(1, \['B'\]\)"):
        ReshapeJob(df, [["A"], ["B"]], strict_per_slot=True).plan(spark)
    with pytest.raises(ValueError, match="order_by"):
        ReshapeJob(df, [["A"]], skip="0").plan(spark)


def test_empty_input_writes_headers(spark, tmp_path):
    df = spark.createDataFrame([], "A string, B string")
    output, metrics = ReshapeJob(df, [["A"], ["B"]]).run(spark, str(tmp_path / "o.csv"))
    assert metrics.rows == 0 and open_table(spark, output).columns == ["A", "B"]


def test_first_rows_of_a_stream(spark, tmp_path, rows):
    landing, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lots = [[(0, "a", 1), (1, "b", 2), (2, "a", 3)], [(3, "b", 4), (4, "c", 5)], [(5, None, 6), (6, "c", 7)]]
    schema = "idx int, K string, V int"
    for lot in lots:
        spark.createDataFrame(lot, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        write_first_rows(stream, "K", ["V"], "idx", target, state).awaitTermination()
    assert rows(read_first_rows(spark, target)) == [("a", 1), ("b", 2), ("c", 5)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, rows):
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "idx int, K string"
    spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], schema).write.parquet(landing)
    for state in ("one", "two"):  # a lost checkpoint: batch 0 comes again
        stream = spark.readStream.schema(schema).parquet(landing)
        write_first_rows(stream, "K", ["idx"], "idx", target, str(tmp_path / state)).awaitTermination()
    assert rows(read_first_rows(spark, target)) == [("a", 0), ("b", 2)]


def test_batches_of_a_lost_checkpoint_come_again(spark, tmp_path, rows):
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "n int, K string"
    for lot in ([(0, "a"), (1, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(landing)
    for state, files in (("one", 1), ("two", 2), ("three", 1)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
        query = write_first_rows(stream, "K", ["n"], "n", target, str(tmp_path / state), {"availableNow": True})
        query.awaitTermination()
    assert rows(read_first_rows(spark, target).select("K")) == [("a",), ("b",), ("c",)]


def test_a_batch_reads_nothing_it_wrote(spark, tmp_path, rows):
    """Batches after the first meet no file of the table, and give columns called like its folders once were."""
    landing, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "batch_id int, run_id string, n int"
    for lot in ([(0, "a", 1), (0, "b", 2)], [(1, "b", 0), (1, "c", 4)], [(2, "c", 5), (2, "d", 6)]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    write_first_rows(stream, "run_id", ["batch_id", "n"], "n", target, state).awaitTermination()
    for part in (tmp_path / "out").rglob("*.parquet"):  # another batch would fail on these
        part.write_bytes(b"")
    spark.createDataFrame([(3, "d", 0), (3, "e", 7)], schema).coalesce(1).write.mode("append").parquet(landing)
    there = list((tmp_path / "out").rglob("_first_rows_batch=*"))
    assert len(there) == 3
    from gridweave.streaming import dedupe

    old, dedupe._written = dedupe._written, lambda *_: None
    try:
        write_first_rows(stream, "run_id", ["batch_id", "n"], "n", target, state).awaitTermination()
    finally:
        dedupe._written = old
    new = [p for p in (tmp_path / "out").rglob("_first_rows_batch=*") if p not in there]
    assert rows(spark.read.parquet(str(new[0]))) == [("e", 3, 7)]


def test_a_new_checkpoint_needs_a_new_run(spark, tmp_path):
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    for lot in ([(0, "a")], [(1, "b")]):
        spark.createDataFrame(lot, "n int, K string").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema("n int, K string").option("maxFilesPerTrigger", 1).parquet(landing)
    write_first_rows(stream, "K", ["n"], "n", target, str(tmp_path / "one"), run="r").awaitTermination()
    with pytest.raises(Exception, match="name another run"):
        write_first_rows(stream, "K", ["n"], "n", target, str(tmp_path / "two"), run="r").awaitTermination()
    with pytest.raises(ValueError, match="folders"):
        write_first_rows(stream, "_first_rows_run", ["n"], "n", target, str(tmp_path / "three"))


def test_metrics_of_batches(spark, tmp_path):
    landing = str(tmp_path / "in")
    for n in (3, 5, 2):
        spark.range(n).coalesce(1).write.mode("append").parquet(landing)
    log = BatchLog()
    spark.streams.addListener(log)
    try:
        stream = observed(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(landing))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        found = log.wait(query)
    finally:
        spark.streams.removeListener(log)
    assert sorted(m.rows for m in found if m.rows) == [2, 3, 5] and all(m.seconds > 0 and m.rows_per_second > 0 for m in found if m.rows)


def test_stateful_stream(spark, tmp_path, rows):
    landing = str(tmp_path / "in")
    spark.sql("SELECT id % 5 AS k, timestamp_seconds(id) AS ts FROM range(100)").repartition(4).write.parquet(landing)
    for setting in ({}, {"event_time": "ts", "delay": "1 hour"}):
        stream = spark.readStream.schema("k bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(landing)
        name = f"kept_{len(setting)}"
        query = dedupe_stream(stream, "k", **setting).writeStream.format("memory").queryName(name)
        query.trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.table(name).select("k")) == [(i,) for i in range(5)]
    with pytest.raises(ValueError):
        dedupe_stream(stream, "k", event_time="ts")


def test_append_to_matches_by_name(spark, tmp_path, rows):
    from gridweave.operators import append_rows
    from gridweave.sources import append_to, write_table

    path = str(tmp_path / "t.parquet")
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    append_to(one, path)
    append_to(spark.createDataFrame([("y", 2)], "b string, a int"), path)
    append_to(spark.createDataFrame([("z",)], "b string"), path)
    assert rows(spark.read.parquet(path).select("a", "b")) == sorted([(1, "x"), (2, "y"), (None, "z")], key=repr)
    with pytest.raises(ValueError):
        append_to(spark.createDataFrame([(1,)], "c int"), path)
    write_table(one, str(tmp_path / "u.csv"))
    append_to(spark.createDataFrame([("y", 2)], "b string, a int"), str(tmp_path / "u.csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "u.csv"))) == [("1", "x"), ("2", "y")]
    assert append_rows(one, []).count() == 1


def test_examples_and_list_checks_see_all_rows(spark, rows):
    from gridweave.operators import column_examples, run_list_check

    df = spark.range(400).selectExpr("id", "IF(id < 150, NULL, concat('v', id)) AS late")
    assert rows(column_examples(df, "id", ["late"])) == [("late", ["v150", "v151", "v152"])]
    found = run_list_check(df, ["late"], "n", lambda v: sum(x is not None for x in v), "id", weight=1.0).head()
    assert found.score == 250
