"""Deduplication of a stream, with the keys seen so far kept across batches."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweave.functions.text import quoted
from gridweave.operators.dedupe import exclude_seen, order_value, with_key

# Folders of the table, under names that no column is likely to have.
_RUN, _BATCH = "_first_rows_run", "_first_rows_batch"


def dedupe_stream(df: DataFrame, key: str, *, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """One row per key of a stream, by Spark's own stateful operator.

    Without a watermark the state holds every key ever seen. With ``event_time`` and
    ``delay`` a key is forgotten once the watermark passes it, which bounds the state:
    duplicates are dropped while they come within ``delay`` of each other. Which row of
    a key survives within one batch is Spark's choice; :func:`write_first_rows` keeps
    the first under an order.
    """
    keyed = with_key(df, key)
    if event_time is None:
        return keyed.dropDuplicates([key])
    if delay is None:
        raise ValueError("event_time needs delay")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def first_arrivals(stream: DataFrame, key: str, columns: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """``key, first_row, first_at, last_at`` of a stream, for its ``update`` mode: the first row of each key that a batch holds.

    A key's rows are ordered by the time of their batch, which Spark logs with the batch and so is the same when the batch runs
    again, then by ``order_by``. So the first row of a key is one keyed aggregate: its state lies in Spark's state store, tasks reduce their rows
    before the shuffle, and a batch reads and writes the keys it holds. A key is new in a batch if ``first_at = last_at``.
    """
    others = [c for c in dict.fromkeys(columns) if c != key]
    row = F.struct(*[quoted(c) for c in others]) if others else F.struct(F.lit(True).alias("seen"))
    rows = with_key(stream, key).select(quoted(key).alias("key"), row.alias("row"), order_value(order_by).alias("place"), F.current_timestamp().alias("at"))
    first = F.min_by("row", F.struct("at", "place")).alias("first_row")
    return rows.groupBy("key").agg(first, F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def write_first_rows(
    stream: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: str | Sequence[str],
    target: str,
    checkpoint: str,
    trigger: dict | None = None,
    run: str | None = None,
) -> StreamingQuery:
    """Write the first row per key of a stream to a parquet table, batch by batch.

    Keys seen are the state of :func:`first_arrivals`, kept under the checkpoint. A batch writes its new keys to a folder of its own, so
    one that runs again after a failure gives the same table, and it doesn't read what it wrote before.

    ``run`` names what one checkpoint has written, by default after the checkpoint's folder. A checkpoint that starts anew needs a new name;
    it has no state, so its batches also look at the keys that other runs wrote, a part of the table that no longer
    grows. ``trigger`` holds arguments of Spark's ``trigger``; the default takes what is there and ends.
    """
    if clash := {_RUN, _BATCH} & {key, *columns}:
        raise ValueError(f"the table has folders called {', '.join(sorted(clash))}")
    own = quote(run or posixpath.basename(checkpoint.rstrip("/")), safe="")
    others = [c for c in dict.fromkeys(columns) if c != key]

    spark = stream.sparkSession
    there = _written(spark, target)  # looked at once, at the start
    runs = {r[0]: r[1] for r in there.groupBy(_RUN).agg(F.max(_BATCH)).collect()} if there is not None else {}
    elsewhere = there.where(F.col(_RUN) != own) if set(runs) - {own} else None

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0 and runs.get(own, 0) > 0:
            raise ValueError(f"the checkpoint is new, but the table holds batches of a run {own!r}; name another run")
        new = batch.where("first_at = last_at")
        rows = new.select(F.col("key").alias(key), *[F.col("first_row").getField(c).alias(c) for c in others])
        if elsewhere is not None:
            rows = exclude_seen(rows, key, elsewhere)
        rows.write.mode("overwrite").parquet(f"{target}/{_RUN}={own}/{_BATCH}={batch_id}")

    started = first_arrivals(stream, key, columns, order_by).writeStream.outputMode("update").foreachBatch(write)
    return started.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _written(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df.withColumns({_RUN: F.col(_RUN).cast("string"), _BATCH: F.col(_BATCH).cast("long")})


def read_first_rows(spark: SparkSession, target: str) -> DataFrame:
    """The table that :func:`write_first_rows` has written so far."""
    df = spark.read.parquet(target)
    return df.select(*[quoted(c) for c in df.columns if c not in (_RUN, _BATCH)])
