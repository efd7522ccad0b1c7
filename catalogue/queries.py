"""One query per operator, over whole tables. Each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave import operators as op
from gridweave import sources, streaming
from gridweave.functions import (
    normalize_number,
    normalize_number_list,
    normalize_text,
    normalize_text_list,
)
from gridweave.operators.detectors import TEXT_TYPE
from gridweave.plans import ReshapeJob
from gridweave.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER_TEXTS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Mapping


@query
def map_single(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return op.apply_mapping(orders, [{"sources": ["o_orderkey"]}, {"sources": ["o_orderpriority"]}])


@query
def map_combine(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    slots = [
        {"sources": ["c_name", "c_mktsegment"], "separator": "-"},
        {"sources": ["c_custkey"]},
        {"sources": ["c_nationkey", "c_custkey", "c_name"], "separator": " / "},
    ]
    return op.apply_mapping(customer, slots)


@query
def map_default_separator(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return op.apply_mapping(
        part, [{"sources": ["p_partkey"]}, {"sources": ["p_brand", "p_type"], "separator": ""}]
    )


@query
def map_legacy_string(spark, sf_dir):
    return op.apply_mapping(table(spark, sf_dir, "part"), "p_partkey, p_name ,p_brand,, p_size")


@query
def map_duplicate_slot(spark, sf_dir):
    """The second slot of a name gives the value, the first gives the place."""
    customer = table(spark, sf_dir, "customer").withColumn("Combined_2", F.concat(F.lit("later "), F.col("c_name")))
    slots = [["c_custkey"], ["c_name", "c_mktsegment"], ["c_nationkey"], ["Combined_2"]]
    return op.apply_mapping(customer, slots)


@query
def map_empty_slot(spark, sf_dir):
    return op.apply_mapping(table(spark, sf_dir, "customer"), [["c_custkey"], []])


@query
def map_empty_input(spark, sf_dir):
    none = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "no such segment")
    return op.apply_mapping(none, [["c_custkey"], ["c_name", "c_mktsegment"]])


@query
def map_null_slot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return op.apply_mapping(
        events, [["event_id"], {"sources": ["user_id", "event_type", "event_id"], "separator": "|"}, ["event_type"]]
    )


@query
def missing_columns(spark, sf_dir):
    """A source that is no column reads as empty text, in its own place."""
    return op.apply_mapping(
        table(spark, sf_dir, "customer"),
        [["c_custkey"], {"sources": ["c_name", "no_such_column", "c_nationkey"], "separator": "-"}, ["absent"]],
    )


@query
def map_strict(spark, sf_dir):
    """How a mapping that names absent columns fares under each flag: the rows and letters mapped, or why it is refused."""
    customer = table(spark, sf_dir, "customer")
    gaps = [["c_custkey"], ["c_name", "absent"], ["gone", "c_nationkey", "absent"]]
    cases = [
        ("lenient", gaps, {}),
        ("strict", gaps, {"strict": True}),
        ("per slot", gaps, {"strict_per_slot": True}),
        ("all there", [["c_custkey"], ["c_name", "c_nationkey"]], {"strict": True, "strict_per_slot": True}),
        ("no slot", [], {}),
    ]
    return _tried(customer, [(name, lambda m=m, f=f: op.apply_mapping(customer, m, **f)) for name, m, f in cases])


def _tried(df: DataFrame, cases) -> DataFrame:
    """``case, rows, letters, refused`` per case, a name and a function that gives a table of texts or refuses."""
    out = []
    for name, run in cases:
        refused = None
        try:
            made = run()
        except ValueError as error:
            made, refused = df.where(F.lit(False)), str(error)
        letters = F.coalesce(F.sum(F.length(F.concat(*[F.col(c).cast("string") for c in made.columns]))), F.lit(0))
        counted = made.agg(F.count(F.lit(1)).alias("rows"), letters.alias("letters"))
        out.append(counted.select(F.lit(name).alias("case"), "rows", "letters", F.lit(refused).cast("string").alias("refused")))
    return functools.reduce(DataFrame.union, out)


@query
def map_used_sources(spark, sf_dir):
    """The columns that a mapping needs, each once, in order of first use."""
    mapping = [["o_orderpriority", "o_custkey"], {"sources": ["o_custkey", "o_orderkey"], "separator": "/"}, ["o_orderpriority"]]
    return table(spark, sf_dir, "orders").select(*op.used_sources(mapping))


@query
def validate_names(spark, sf_dir):
    """Tables whose names are fine, repeated after a join, or empty: rows of the first, and why the others are refused."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("o_orderkey"))
    tables = [
        ("fine", orders),
        ("repeated", orders.join(names, F.col("o_custkey") == F.col("c_custkey"))),
        ("empty", orders.toDF("o_orderkey", "")),
    ]

    def valid(df):
        op.validate_columns(df.columns)
        return df

    return _tried(orders, [(name, lambda df=df: valid(df)) for name, df in tables])


@query
def render_text(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    texts = items.select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_extendedprice") * 100000000).alias("wide"),
        (F.col("l_discount") / 1000).alias("narrow"),
        (F.col("l_tax") > 0.04).alias("taxed"),
        "l_shipdate",
    )
    return op.text_columns(texts)


# Deduplication


@query
def dedupe_drop(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    slots = [["user_id"], ["event_type"], {"sources": ["event_id", "props"], "separator": " "}]
    return op.dedupe_and_map(events, slots, op.Dedupe(key="user_id"), order_by="event_id")


@query
def dedupe_concat(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    dedupe = op.Dedupe(key="user_id", strategy="concat")
    return op.dedupe_and_map(events, [["user_id"], ["event_type"]], dedupe, order_by="event_id")


@query
def dedupe_concat_columns(spark, sf_dir):
    """Several merged columns, a composite order, and a slot over two of them."""
    orders = table(spark, sf_dir, "orders")
    slots = [
        ["o_custkey"],
        ["o_orderstatus"],
        {"sources": ["o_orderpriority", "o_orderstatus"], "separator": " # "},
    ]
    dedupe = op.Dedupe(key="o_custkey", strategy="concat", separator=",")
    return op.dedupe_and_map(orders, slots, dedupe, order_by=["o_orderdate", "o_orderkey"])


@query
def dedupe_concat_rows(spark, sf_dir):
    """The merge in long form: one row per key, column and distinct value."""
    orders = table(spark, sf_dir, "orders")
    return op.distinct_values(orders, "o_custkey", ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query
def dedupe_concat_key_named_value(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.floor("value").cast("long").alias("value"), "event_type", "event_id")
    return op.merge_values(events, "value", ["event_type"], "event_id")


@query
def dedupe_concat_key_only(spark, sf_dir):
    dedupe = op.Dedupe(key="l_suppkey", strategy="concat")
    return op.dedupe_and_map(table(spark, sf_dir, "lineitem"), [["l_suppkey"]], dedupe, order_by="l_orderkey")


@query
def dedupe_null_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = (
        F.when(F.col("value") > 20, F.lit(float("nan")))
        .when(F.col("event_type") != "error", F.col("user_id").cast("double"))
    )
    slots = [["k"], ["event_id"], ["event_type"]]
    return op.dedupe_and_map(events.withColumn("k", key), slots, op.Dedupe(key="k"), order_by="event_id")


@query
def dedupe_concat_blanks(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "view", F.col("event_type"))
    events = table(spark, sf_dir, "events").withColumn("event_type", kind)
    dedupe = op.Dedupe(key="props", strategy="concat", separator="+")
    return op.dedupe_and_map(events, [["props"], ["event_type"]], dedupe, order_by="event_id")


@query
def dedupe_disabled(spark, sf_dir):
    """A key that is no column switches deduplication off: every row is mapped."""
    dedupe = op.Dedupe(key="no_such_column", strategy="concat")
    return op.dedupe_and_map(table(spark, sf_dir, "orders"), [["o_orderkey"], ["o_custkey"]], dedupe)


@query
def incremental_dedupe(spark, sf_dir):
    """First order of each customer among the orders not urgent, for customers without urgent orders."""
    orders = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    first = op.dedupe_increment(
        orders.where(~urgent),
        "o_custkey",
        ["o_orderkey", "o_orderstatus", "o_orderpriority"],
        "o_orderkey",
        seen=orders.where(urgent),
    )
    return first


@query
def stream_dedupe(spark, sf_dir):
    """Orders arrive in two lots, the stream runs after each; the first order of each customer stays."""
    orders = table(spark, sf_dir, "orders")
    landing, target, state = (fresh_path(spark, name) for name in ("arrivals", "first-orders", "stream-state"))
    early = F.col("o_orderdate") < "1996-01-01"
    for lot in (orders.where(early), orders.where(~early)):
        lot.write.mode("append").parquet(landing)
        run = streaming.write_first_rows(
            spark.readStream.schema(orders.schema).parquet(landing),
            "o_custkey",
            ["o_orderkey", "o_orderstatus"],
            ["o_orderdate", "o_orderkey"],
            target,
            checkpoint=state,
        )
        run.awaitTermination()
    return streaming.read_first_rows(spark, target)


LOT_FILES = 8


@query
def stream_dedupe_replay(spark, sf_dir):
    """The checkpoint is lost after two lots, and all arrives again, a file in each batch: no key comes twice.

    A lot comes as ``LOT_FILES`` files however many splits its table has, so batches grow with the input, not their number.
    """
    orders = table(spark, sf_dir, "orders")
    landing, target = fresh_path(spark, "arrivals"), fresh_path(spark, "first-orders")
    early = F.col("o_orderdate") < "1996-01-01"
    lost = fresh_path(spark, "stream-state")
    for lot, state in ((orders.where(early), lost), (orders.where(~early), lost), (orders.limit(0), fresh_path(spark, "stream-state"))):
        lot.repartition(LOT_FILES).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1 if state != lost else 1000).parquet(landing)
        order = ["o_orderdate", "o_orderkey"]
        streaming.write_first_rows(stream, "o_custkey", ["o_orderkey", "o_orderstatus"], order, target, state).awaitTermination()
    return streaming.read_first_rows(spark, target)


@query
def stream_metrics(spark, sf_dir):
    """Orders arrive month by month of a year, a batch each: the rows that each batch let through, as the stream counted them."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'")
    landing, kept = fresh_path(spark, "arrivals"), fresh_path(spark, "metrics")
    months = orders.withColumn("month", F.month("o_orderdate"))
    months.repartition(12, "month").sortWithinPartitions("month").write.partitionBy("month").parquet(landing)
    log = streaming.BatchLog()
    spark.streams.addListener(log)
    try:
        arrivals = spark.readStream.schema(months.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        passed = streaming.observed(arrivals.where("o_orderstatus <> 'P'"))
        run = passed.writeStream.format("noop").option("checkpointLocation", fresh_path(spark, "stream-state")).trigger(availableNow=True).start()
        found = [(m.rows, m.seconds > 0 and m.rows_per_second > 0) for m in log.wait(run) if m.rows]
    finally:
        spark.streams.removeListener(log)
    spark.createDataFrame(found, "n_rows long, timed boolean").write.parquet(kept)
    return spark.read.parquet(kept)


@query
def stream_dedupe_keys(spark, sf_dir):
    """Spark's stateful duplicate removal over a stream of events: the keys that remain."""
    events = table(spark, sf_dir, "events")
    arrivals = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target = fresh_path(spark, "stream-keys")
    run = (
        streaming.dedupe_stream(arrivals, "user_id")
        .select("user_id")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(target)


# Row positions and samples


@query
def row_index(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    indexed = op.with_row_index(events, ["user_id", "ts", "event_id"], rows_per_range=2_500)
    return indexed.select("idx", "event_id", "user_id")


@query
def row_index_many_ranges(spark, sf_dir):
    """Ranges of few rows, so that their bounds become a searched array."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    indexed = op.with_row_index(events, ["user_id", "ts", "event_id"], rows_per_range=200, index="place")
    return indexed.select(F.col("place").alias("idx"), "event_id", "user_id")


@query
def skip_rows_named_idx(spark, sf_dir):
    """A column called like a position keeps its values and its place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("idx"))
    return op.skip_rows(orders, "0, 3-5", "o_orderkey")


@query
def preview_named_idx(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("idx"))
    return op.preview(orders, [["o_orderkey"], ["idx"]], "o_orderkey")


@query
def skip_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return op.skip_rows(orders, [3, 0, 1, 3, -4, 17], "o_orderkey")


@query
def skip_prefix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return op.skip_rows(orders, 250, "o_orderkey")


@query
def skip_rows_expr(spark, sf_dir):
    """Positions far from the head, so the full index is built."""
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return op.skip_rows(items, "0, 6-4, 9..11,, 12000-13000", ["o_orderdate", "o_orderkey"])


@query
def preview(spark, sf_dir):
    slots = [["o_orderkey"], {"sources": ["o_custkey", "o_orderpriority"], "separator": ":"}]
    return op.preview(table(spark, sf_dir, "orders"), slots, "o_orderkey")


@query
def column_sample(spark, sf_dir):
    return op.column_sample(table(spark, sf_dir, "orders"), 100, "o_orderkey", columns=ORDER_TEXTS)


@query
def column_sample_chunked(spark, sf_dir):
    return op.column_sample(table(spark, sf_dir, "orders"), 3, "o_orderkey", columns=ORDER_TEXTS, chunk=1000, rows_per_range=400)


# Tables


@query
def append_rows(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")
    )
    return op.append_rows(customer, supplier)


@query
def scan_csv_headers_differ(spark, sf_dir):
    """Two files of one folder: columns in another order, and lines before one header."""
    path = fresh_path(spark, "headers")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customer.where("c_custkey % 2 = 0").coalesce(1).write.option("header", True).csv(path)
    turned = customer.where("c_custkey % 2 = 1").select("c_name", F.col("c_custkey").cast("string"), "c_mktsegment")
    lines = turned.select(F.concat_ws(",", *turned.columns).alias("value"))
    head = spark.sql("SELECT explode(array('', ' ', 'c_name,c_custkey,c_mktsegment')) AS value")
    head.coalesce(1).unionAll(lines.coalesce(1)).coalesce(1).write.mode("append").option("compression", "none").text(path)
    return sources.read_csv(spark, path, headers="each").select("c_custkey", "c_name", "c_mktsegment")


@query
def append_csv(spark, sf_dir):
    """Rows added to a table on disk, with the columns in another order and one missing."""
    path = fresh_path(spark, "appended") + ".csv"
    customer = table(spark, sf_dir, "customer")
    sources.write_table(customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    sources.append_to(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("c_custkey")), path)
    return spark.read.option("header", True).csv(path)


@query
def row_count(spark, sf_dir):
    return op.row_count(table(spark, sf_dir, "lineitem"))


@query
def schema_report(spark, sf_dir):
    """Types of the values of a text table, with a gap in one whole-number column."""
    orders = table(spark, sf_dir, "orders")
    gap = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    texts = op.text_columns(
        orders.select("o_orderkey", gap.alias("o_custkey"), "o_totalprice", "o_orderpriority",
                      (F.col("o_totalprice") > 1000).alias("large"))
    )
    return op.schema_report(texts)


@query
def file_metadata(spark, sf_dir):
    return sources.file_report(table(spark, sf_dir, "lineitem")).select("file_name", "row_count")


@query
def apply_layout(spark, sf_dir):
    layout = op.Layout.of(
        {
            "components": ["header", "body"],
            "header": ["company", "number", "country"],
            "body": [{"columnType": "companyname"}, {"columnType": "number"}, {"columnType": "country"}],
        }
    )
    return op.apply_layout(table(spark, sf_dir, "customer"), layout, ["c_name", "c_custkey", "c_nationkey"])


@query
def layout_sections(spark, sf_dir):
    layout = op.Layout.of(
        {"header": [["Customers", ""], ["company", "number"]], "footer": [["end of list"]], "components": []}
    )
    body = op.apply_layout(table(spark, sf_dir, "customer"), layout, ["c_name", "c_custkey"])
    return op.with_sections(body, layout)


# Files


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_columns(table(spark, sf_dir, "orders").select(*ORDER_TEXTS))


def _export_csv(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "orders") + ".csv"
    sources.write_table(_order_texts(spark, sf_dir), path)
    return path


def _export_lines(spark: SparkSession, sf_dir: str, opening: list[str], line) -> str:
    """Orders as text files, one per month, by order key, each with opening lines."""
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), *ORDER_TEXTS)
    texts = op.text_columns(orders)
    body = texts.select("month", F.col("o_orderkey").cast("bigint").alias("at"), line.alias("value"))
    titles = F.posexplode(F.array(*[F.lit(text) for text in opening])).alias("at", "value")
    first = orders.select("month").distinct().select("month", titles)
    first = first.withColumn("at", (F.col("at") - len(opening)).cast("bigint"))
    path = fresh_path(spark, "lines") + ".csv"
    lines = body.unionByName(first).repartition("month").sortWithinPartitions("month", "at").drop("at")
    lines.write.partitionBy("month").text(path)
    return path


def _csv_line():
    return F.concat_ws(",", *[F.col(c) for c in ORDER_TEXTS])


@query
def scan_csv(spark, sf_dir):
    return sources.open_table(spark, _export_csv(spark, sf_dir))


@query
def scan_csv_types(spark, sf_dir):
    return sources.open_table(spark, _export_csv(spark, sf_dir), infer_types=True)


@query
def scan_csv_skip(spark, sf_dir):
    """Each file opens with a title and the header; title and first two orders are skipped."""
    path = _export_lines(spark, sf_dir, ["Orders, a list", ",".join(ORDER_TEXTS)], _csv_line())
    return sources.read_csv(spark, path, skip="0, 2-3")


@query
def scan_csv_bad_rows(spark, sf_dir):
    """Rows with a field too many are left out, rows with one too few are padded."""
    full = [F.col(c) for c in ORDER_TEXTS]
    line = (
        F.when(F.col("o_orderstatus") == "P", F.concat_ws(",", *full, F.lit("extra")))
        .when(F.col("o_orderstatus") == "F", F.concat_ws(",", *full[:-1]))
        .otherwise(F.concat_ws(",", *full))
    )
    path = _export_lines(spark, sf_dir, [",".join(ORDER_TEXTS)], line)
    return sources.read_csv(spark, path, bad_rows="skip")


@query
def scan_csv_missing_values(spark, sf_dir):
    """Marks for a missing value read as null; other texts stay."""
    orders = _order_texts(spark, sf_dir)
    word = F.when(F.col("o_orderstatus") == "P", "N/A").when(F.col("o_orderstatus") == "F", "none")
    texts = orders.select("o_orderkey", word.alias("word"), F.lit(",\"quoted\"").alias("marks"))
    path = fresh_path(spark, "gaps") + ".csv"
    sources.write_table(texts, path)
    return sources.read_csv(spark, path)


@query
def scan_csv_multi_line(spark, sf_dir):
    """Whole documents, line breaks and quotes and all, through CSV."""
    path = fresh_path(spark, "documents") + ".csv"
    sources.write_table(op.text_columns(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), path)
    return sources.read_csv(spark, path, multi_line=True, na_tokens=[])


def _quoted_field(text):
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


FILE_BYTES = 32 << 20  # of text in a file of records, about


@query
def scan_csv_records_skip(spark, sf_dir):
    """Documents with their line breaks, in files of one language each; a title and the language's first two documents, all over several
    lines, open each file and are skipped by number, and the header spans two lines."""
    documents = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND lang IS NOT NULL")
    marked = F.concat(F.lit('a "b", \r\n'), F.coalesce("text", F.lit("")))
    body = documents.select("lang", F.col("doc_id").alias("at"), F.concat(F.col("doc_id"), F.lit(","), _quoted_field(marked)).alias("value"))
    # A language's rows up to its second key stay in its first file, the rest is dealt to as many files as its size asks for.
    first = documents.select("lang", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 2")
    sizes = documents.groupBy("lang").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32).alias("size"))
    files = sizes.join(first.groupBy("lang").agg(F.max("doc_id").alias("second")), "lang")
    files.select("lang", "second", F.ceil(F.col("size") / FILE_BYTES).cast("int").alias("files")).write.parquet(kept := fresh_path(spark, "files"))
    files = spark.read.parquet(kept)  # a row for each language
    total = files.agg(F.sum("files")).first()[0] or 1
    body = body.join(F.broadcast(files), "lang")
    file = F.when(F.col("at") > F.col("second"), F.pmod(F.xxhash64("at"), F.col("files"))).otherwise(0).cast("int")
    every = lambda begin: F.explode(F.sequence(F.lit(begin), F.col("files") - 1)).alias("file")
    opening = body.where("at <= second AND files > 1").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "value")))
    opening = opening.where("n <= 2").select("lang", F.col("at"), "value", every(1))
    titles = F.posexplode(F.array(F.lit('"Documents, a\nlist"'), F.lit('"doc\nid",text'))).alias("at", "value")
    heads = files.select("lang", every(0)).select("lang", "file", titles)
    heads = heads.withColumn("at", (F.col("at") - (1 << 40)).cast("bigint"))
    path = fresh_path(spark, "records") + ".csv"
    lines = body.select("lang", file.alias("file"), "at", "value").unionByName(opening).unionByName(heads)
    lines = lines.repartition(4 * total, "lang", "file").sortWithinPartitions("lang", "file", "at").drop("at")
    lines.write.partitionBy("lang", "file").text(path)
    return sources.read_csv(spark, path, multi_line=True, skip="0, 2-3", na_tokens=[]).toDF("doc_id", "text")


@query
def scan_csv_case_names(spark, sf_dir):
    """Names that differ in case only, and a repeated one."""
    nation = table(spark, sf_dir, "nation")
    path = fresh_path(spark, "nations") + ".csv"
    lines = nation.select(F.col("n_nationkey").alias("at"), F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey", "n_name").alias("value"))
    header = nation.limit(1).select(F.lit(-1).cast(lines.schema["at"].dataType).alias("at"), F.lit("Key,name,KEY,Name").alias("value"))
    lines.union(header).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return sources.read_csv(spark, path).select("Key", "name", F.col("`KEY.1`").alias("key_1"), F.col("`Name.1`").alias("name_1"))


@query
def scan_csv_other_headers(spark, sf_dir):
    """Pairs of files by the first letters of nations, the second with another header: which of them a scan refuses."""
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    found = None
    for first, second in (("a,b", "a,b"), ("a,b", "b,a"), ("a,a", "a,a"), ("a,a", "x,y"), ("a,", "a,x"), ("A,a", "a,A")):
        path = fresh_path(spark, "pair") + ".csv"
        for name, early in ((first, True), (second, False)):
            part = nation.where((F.col("n_name") < "J") if early else (F.col("n_name") >= "J"))
            lines = part.select(F.concat_ws(",", "n_name", "n_nationkey").alias("value"), F.lit(1).alias("at"))
            head = nation.limit(1).select(F.lit(name).alias("value"), F.lit(0).alias("at"))
            lines.union(head).coalesce(1).sortWithinPartitions("at").select("value").write.mode("append").text(path)
        try:
            rows = sources.read_csv(spark, path).toDF("x", "y").groupBy().agg(F.count("*").alias("n_rows"))
            rows.write.parquet(at := fresh_path(spark, "counted"))
            rows = spark.read.parquet(at)
        except (PySparkException, Py4JJavaError):  # the native reader's refusal comes as the latter
            rows = nation.limit(1).select(F.lit(None).cast("long").alias("n_rows"))
        rows = rows.select(F.lit(first).alias("first"), F.lit(second).alias("second"), "n_rows")
        found = rows if found is None else found.union(rows)
    return found


@query
def own_format_roundtrip(spark, sf_dir):
    """Orders through a format that Spark lacks: written, half of them anew, the others appended."""
    sources.register_format(spark, sources.ArrowFiles())
    orders = table(spark, sf_dir, "orders")
    path = fresh_path(spark, "orders") + ".arrow"
    sources.write_table(orders.repartition(4), path)
    sources.write_table(orders.where("o_orderkey % 2 = 0").repartition(3), path)
    sources.append_to(orders.where("o_orderkey % 2 = 1").repartition(3), path)
    return sources.open_table(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query
def scan_directory(spark, sf_dir):
    """A folder that holds other files as well."""
    path = _export_csv(spark, sf_dir)
    table(spark, sf_dir, "customer").write.mode("append").json(path)
    return sources.scan_directory(spark, path, pattern=r"^part-\d+")


@query
def roundtrip_csv(spark, sf_dir):
    """CSV to parquet by suffix, then read back."""
    target = fresh_path(spark, "copy") + ".parquet"
    sources.copy_table(spark, _export_csv(spark, sf_dir), target)
    return sources.open_table(spark, target)


@query
def reshape_job(spark, sf_dir):
    """A whole run on files: skip the title, keep each customer's first line in file order, map, write."""
    line = F.concat_ws(";", "o_custkey", "o_orderkey", "o_orderpriority")
    job = ReshapeJob.of(
        {
            "source": _export_lines(spark, sf_dir, ["title", "customer;order;priority"], line),
            "mapping": [{"sources": ["customer"]}, {"sources": ["order", "priority"], "separator": " "}],
            "skip_rows": [0],
            "dedupe": {"enabled": True, "key": "customer", "strategy": "drop"},
        },
        options={"sep": ";"},
        strict=True,
    )
    target, _ = job.run(spark, fresh_path(spark, "job") + ".csv")
    return sources.open_table(spark, target, sep=";")


@query
def reshape_default_output(spark, sf_dir):
    """A run that names no output writes beside its input."""
    source = _export_lines(spark, sf_dir, ["customer;order;priority"], F.concat_ws(";", "o_custkey", "o_orderkey", "o_orderpriority"))
    job = ReshapeJob.of({"source": source, "mapping": "order, priority"}, options={"sep": ";"})
    target, _ = job.run(spark)
    beside = F.lit(target == sources.processed_path(source)).alias("beside")
    return sources.open_table(spark, target, sep=";").select("order", "priority", beside)


# Checks


@query
def check_match_ratio(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.groupBy("lang").agg(op.match_ratio(F.col("n_chars") > 1000).alias("ratio")).withColumn(
        "ratio", F.round("ratio", 6)
    )


def _rounded(checked: DataFrame) -> DataFrame:
    return checked.withColumn("score", F.round("score", 6))


@query
def check_string(spark, sf_dir):
    return _rounded(op.run_checks(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], [op.string_check()]))


@query
def check_numeric(spark, sf_dir):
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    customer = table(spark, sf_dir, "customer").withColumn("c_acctbal", balance)
    return _rounded(op.run_checks(customer, ["c_name", "c_acctbal"], [op.numeric_check()]))


@query
def check_variance(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return _rounded(op.run_checks(items, ["l_discount", "l_quantity"], [op.variance_check(high=0.2)]))


@query
def check_pattern(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return _rounded(op.run_checks(documents, ["text", "lang"], [op.pattern_check("[0-9]{3}-[0-9]{4}|en", weight=2.0)]))


@query
def check_length(spark, sf_dir):
    return _rounded(op.run_checks(table(spark, sf_dir, "documents"), ["text", "lang"], [op.length_check(2, 400)]))


@query
def check_length_variance(spark, sf_dir):
    return _rounded(
        op.run_checks(table(spark, sf_dir, "part"), ["p_name", "p_partkey"], [op.length_variance_check(low=3.0)])
    )


@query
def check_uniqueness(spark, sf_dir):
    brand = F.when(F.col("p_size") > 10, F.col("p_brand"))
    part = table(spark, sf_dir, "part").withColumn("p_brand", brand)
    return _rounded(op.run_checks(part, ["p_brand", "p_partkey"], [op.uniqueness_check(low=0.8, weight=1.5)]))


@query
def check_date(spark, sf_dir):
    day = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "MMMM d, yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("day "), F.date_format(day, "yyyy-MM-dd")))
    )
    orders = table(spark, sf_dir, "orders").withColumn("written", written)
    return _rounded(op.run_checks(orders, ["written", "o_orderdate", "o_custkey"], [op.date_check()]))


@query
def check_boolean(spark, sf_dir):
    answer = F.when(F.col("toxic") == 1, "Yes").when(F.col("quality") == 1, "no").otherwise("maybe")
    labels = table(spark, sf_dir, "labels").withColumn("answer", answer)
    return _rounded(op.run_checks(labels, ["quality", "answer", "doc_id"], [op.boolean_check()]))


@query
def check_alpha(spark, sf_dir):
    return _rounded(op.run_checks(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"], [op.alpha_check()]))


@query
def check_custom(spark, sf_dir):
    """A check of one's own, as a test on the cells."""
    shout = op.predicate_check("shout", lambda c: c.text == F.upper(c.text), weight=1.0)
    return _rounded(op.run_checks(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], [shout]))


@query
def check_list_function(spark, sf_dir):
    """A check of one's own over the list of all values of a column."""
    customer = table(spark, sf_dir, "customer")

    def repeats(values):
        return 1 - len(set(values)) / len(values)

    return _rounded(
        op.run_list_check(customer, ["c_nationkey", "c_mktsegment"], "repeats", repeats, "c_custkey", weight=1.0)
    )


@query
def check_folded_function(spark, sf_dir):
    """A rule of one's own in states that merge: the share of orders with the least text length."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")

    def fold(state, values):
        lengths = [len(v) for v in values if v is not None]
        least = min(lengths, default=1 << 62)
        new = b"%d %d %d" % (least, lengths.count(least), len(values))
        return merge(state, new) if state else new

    def merge(a, b):
        (x, n, t), (y, m, u) = (map(int, s.split()) for s in (a, b))
        least = min(x, y)
        return b"%d %d %d" % (least, n * (x == least) + m * (y == least), t + u)

    def score(state):
        _, n, total = map(int, state.split())
        return n / total

    found = op.run_folded_check(orders, ["o_orderpriority", "o_orderkey"], "shortest", fold, merge, score, weight=1.0)
    return _rounded(found)


# Classification


@query
def detector_scores(spark, sf_dir):
    scores = op.detector_scores(op.classify(table(spark, sf_dir, "customer"), sample=None))
    return scores.select("column_name", "type", F.round("score", 6).alias("score"))


@query
def column_types(spark, sf_dir):
    best = op.best_types(op.classify(table(spark, sf_dir, "orders"), sample=None))
    return best.withColumn("score", F.round("score", 6))


@query
def column_root_types(spark, sf_dir):
    return op.root_types(op.classify(table(spark, sf_dir, "part"), sample=None))


@query
def column_types_sampled(spark, sf_dir):
    """Judged by the first 100 rows, as an interactive user would."""
    best = op.best_types(op.classify(table(spark, sf_dir, "customer"), sample=100, order_by="c_custkey"))
    return best.withColumn("score", F.round("score", 6))


@query
def column_types_own(spark, sf_dir):
    """Types that the default set lacks: zip codes, and a type of one's own with its keyword."""
    customer = table(spark, sf_dir, "customer")
    shown = customer.select(
        F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("zip"),
        F.upper("c_mktsegment").alias("segment"),
        "c_acctbal",
    )
    own = TEXT_TYPE.child("marketsegment", [op.pattern_check(r"^[A-Z]+$", weight=2.0, name="marketsegment_pattern")], ["segment"])
    best = op.best_types(op.classify(shown, detectors=(*op.DETECTORS, op.ZIP_CODE, own)))
    return best.withColumn("score", F.round("score", 6))


@query
def column_examples(spark, sf_dir):
    found = op.column_examples(table(spark, sf_dir, "customer"), "c_custkey")
    return found.select("column_name", F.concat_ws(" | ", "examples").alias("examples"))


# Scalar functions


@query
def normalize_numbers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.round(normalize_number(F.col("l_discount")), 6).alias("discount"),
        F.round(normalize_number(F.col("l_quantity") - 25, 10.0), 6).alias("quantity"),
    )


@query
def normalize_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    padded = F.when(F.col("lang") != "fr", F.concat(F.lit(" \n"), F.col("text"), F.lit("\t ")))
    return documents.select("doc_id", normalize_text(padded).alias("text"))


@query
def normalize_number_lists(spark, sf_dir):
    lists = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(normalize_number_list(F.col("embedding"))).alias("place", "value")
    )
    return lists.select("vec_id", "place", F.round("value", 6).alias("value"))


@query
def normalize_text_lists(spark, sf_dir):
    parts = F.transform(F.split("text", "\\."), lambda s: F.nullif(s, F.lit("")))
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize_text_list(parts).alias("texts"))
    return texts.select("conv_id", "turn", F.posexplode("texts").alias("place", "part"))
