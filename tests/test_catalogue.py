"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from catalogue.oracles import ORACLES
from catalogue.queries import QUERIES
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name).startswith("same")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "event_type"] and df.count() > 0


def _documents(spark, tmp_path):
    rows = [(i, f'text {i}\n"quoted", and more ' + "x" * 300, "en" if i % 4 else "de") for i in range(400)] + [(1, "of the first key again", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_records_of_a_language_lie_in_several_files(spark, tmp_path, monkeypatch):
    from catalogue import queries

    rows = _documents(spark, tmp_path)
    monkeypatch.setattr(queries, "FILE_BYTES", 8 << 10)
    found = queries.scan_csv_records_skip(spark, str(tmp_path))
    own = sorted((str(i), 'a "b", \r\n' + t) for i, t, lang in sorted(rows, key=lambda r: r[0]) if (i > 1 if lang == "en" else i > 4))
    assert sorted(map(tuple, found.collect())) == own
    files = found.inputFiles()
    assert sum("lang=en" in f for f in files) > 8 and sum("lang=de" in f for f in files) > 3


def test_batches_of_a_replay_do_not_grow_with_splits(spark, tmp_path, monkeypatch):
    from gridweave import streaming

    orders = spark.sql("SELECT id AS o_orderkey, id % 50 AS o_custkey, 'O' AS o_orderstatus, CAST(date_add(date'1995-06-01', CAST(id AS int)) AS timestamp) AS o_orderdate FROM range(400)")
    orders.repartition(25).write.option("maxRecordsPerFile", 8).parquet(f"{tmp_path}/orders.parquet")
    runs, write = [], streaming.write_first_rows

    def counted(*args, **rest):
        runs.append(write(*args, **rest))
        return runs[-1]

    monkeypatch.setattr(streaming, "write_first_rows", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = QUERIES["stream_dedupe_replay"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["o_orderkey"] for r in found) == list(range(50))
    assert runs[-1].lastProgress["batchId"] <= 17
