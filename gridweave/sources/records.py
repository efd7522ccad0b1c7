"""Records of text files whose quoted fields may hold line breaks, cut and numbered in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.session import fresh_path

# Blocks are rows of a few numbers; above this many they are joined by shuffle.
BROADCAST_BLOCKS = 200_000

_IDS = ["_task", "_file", "_block", "_length"]


def block_columns() -> list[Column]:
    """What names a block of a text scan, and rises by one a line: task, file, block start and length, row id."""
    meta = [F.col(f"_metadata.file_{m}").alias(f"_{n}") for m, n in (("path", "file"), ("block_start", "block"), ("block_length", "length"))]
    return [F.spark_partition_id().cast("long").alias("_task"), *meta, F.monotonically_increasing_id().alias("_row")]


def written(blocks: DataFrame) -> DataFrame:
    """Rows of blocks in the shared folder, so all that follows meets the same ones."""
    path = fresh_path(blocks.sparkSession, "blocks")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.parquet(path)


def with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of a scan beside what ``blocks`` knows of their block. A row of an unknown block raises.

    ``blocks`` come from :func:`written`; they are broadcast up to ``BROADCAST_BLOCKS``. Beyond, rows are shuffled by block and sorted, so a block's rows stay together in order.
    """
    known = blocks.withColumn("_known", F.lit(True))
    if blocks.count() <= BROADCAST_BLOCKS:
        joined = rows.join(F.broadcast(known), _IDS, "left")
    else:
        joined = rows.join(known, _IDS, "left").repartition(*_IDS).sortWithinPartitions(*_IDS, "_row")
    lost = F.raise_error(F.lit("input splits changed between two passes over the files; run the scan again"))
    return joined.where(F.when(F.col("_known"), F.lit(True)).otherwise(lost.cast("boolean"))).drop("_known")


def _ends_inside(value: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends within quotes, if it begins within (outside of) them.

    A quote opens at the beginning of a field, and after a quote that has just closed (a doubled one); any other quote
    outside is a character of its field.
    """
    start, within, closed, other = (F.lit(i) for i in range(4))

    def at_quote(state: Column, before: Column) -> Column:
        opens = before.endswith(sep) | ((before == "") & (state != other))
        return F.when(state == within, closed).when(opens, within).otherwise(other)

    pieces = F.split(value, '"')
    state = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), within if inside else start, at_quote)
    return F.when(F.contains(value, F.lit('"')), state == within).otherwise(F.lit(inside))


def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line ends within quotes, from how it ends by either beginning, and the beginning of the first.

    A line keeps the state, turns it, or sets it. After the last line that sets it, the number of turns decides.
    """
    turns = np.cumsum(outside & ~inside) & 1
    sets = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    since = np.where(sets >= 0, outside[sets] ^ (turns[sets] == 1), start)
    return since ^ (turns == 1)


_SUMMARY = "first long, n long, " + ", ".join(f"{c}_{s} long" for s in ("out", "in") for c in ("state", "ends", "head", "tail"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    key = batch.column("key").to_numpy()
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    yield from zip(edges, edges[1:], strict=False)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: for both states it may begin with, its last state, the records that end in it, and the lines
    up to the first end and after the last."""
    done: list[dict] = []
    key = None
    for batch in batches:
        for at, end in _runs(batch):
            if not at < end:
                continue
            part = batch.slice(at, end - at)
            rows = part.column("_row").to_numpy()
            if done and part.column("key")[0].as_py() == key:
                block = done[-1]
            else:
                key = part.column("key")[0].as_py()
                block = {c: part.column(c)[0].as_py() for c in _IDS} | {"first": int(rows[0]), "n": 0}
                for s, state in (("out", 0), ("in", 1)):
                    block |= {f"state_{s}": state, f"ends_{s}": 0, f"head_{s}": 0, f"tail_{s}": 0}
                done.append(block)
            outside, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "inside"))
            for s in ("out", "in"):
                after = states(outside, inside, bool(block[f"state_{s}"]))
                ends = np.flatnonzero(~after)
                if len(ends) and not block[f"ends_{s}"]:
                    block[f"head_{s}"] = block["n"] + int(ends[0]) + 1
                block[f"tail_{s}"] = len(after) - 1 - int(ends[-1]) if len(ends) else block[f"tail_{s}"] + len(after)
                block[f"ends_{s}"] += len(ends)
                block[f"state_{s}"] = int(after[-1])
            block["n"] += len(rows)
    if done:
        yield pa.RecordBatch.from_pylist(done)


def _settled(blocks: DataFrame) -> DataFrame:
    """The state each block begins with, by a prefix pass over the blocks of a file, and the number of its first record."""
    until = Window.partitionBy("_file").orderBy("_block")
    before = until.rowsBetween(Window.unboundedPreceding, -1)
    out, in_ = F.col("state_out"), F.col("state_in")
    turns = F.sum(F.when(out > in_, 1).otherwise(0)).over(until) % 2
    turned = blocks.withColumn("turns", turns)
    sets = F.when(out == in_, out.bitwiseXOR(F.col("turns")))
    after = F.coalesce(F.last(sets, ignorenulls=True).over(until), F.lit(0)).bitwiseXOR(F.col("turns"))
    begun = turned.withColumn("after", after).withColumn("start", F.lag("after", 1, 0).over(until))
    own = lambda c: F.when(F.col("start") == 1, F.col(f"{c}_in")).otherwise(F.col(f"{c}_out"))
    base = F.coalesce(F.sum(own("ends")).over(before), F.lit(0))
    head = F.when(F.col("start") == 1, F.when(F.col("ends_in") > 0, F.col("head_in")).otherwise(F.col("n"))).otherwise(0)
    tail = F.when(F.col("after") == 1, own("tail")).otherwise(0)
    return begun.select(*_IDS, "first", "n", "start", base.alias("base"), own("ends").alias("ends"), head.alias("head"), tail.alias("tail"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole records, in order, as records. Each block's lines begin and end with a record."""
    open_: list[str] = []
    first: tuple | None = None
    key = number = None
    for batch in batches:
        out: list[tuple] = []
        for at, end in _runs(batch):
            if not at < end:
                continue
            part = batch.slice(at, end - at)
            if part.column("key")[0].as_py() != key:
                key, number = part.column("key")[0].as_py(), part.column("number")[0].as_py()
            outside, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "inside"))
            after = states(outside, inside, bool(open_))
            file, block = part.column("_file")[0].as_py(), part.column("_block")[0].as_py()
            for row, value, inside_now in zip(part.column("_row").to_pylist(), part.column("value").to_pylist(), after.tolist(), strict=True):
                if not open_ and not inside_now:
                    out.append((file, block, row, number, value))
                    number += 1
                    continue
                if not open_:
                    first = (file, block, row)
                open_.append(value)
                if not inside_now:
                    out.append((*first, number, "\n".join(open_)))
                    number, open_ = number + 1, []
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["_file", "_block", "_row", "line", "value"])


def quoted_records(lines: DataFrame, sep: str) -> DataFrame:
    """``_file, _block, _row, line, value``: records of a scan of lines (split at ``\\n`` only), numbered from 0 in their file.

    One scan looks at quotes only. Where a block begins, within quotes or not, is not known to its task, so it returns for both
    cases how it ends and how many records end in it: a row per block. A prefix pass over these rows settles states
    and first numbers, and a second scan cuts. A record that lies in two or more blocks is put together from its lines, which are taken out
    of the scan by their row ids; that scan is left out if there are none. Nothing else is shuffled, so one file is cut by as many tasks as
    it has splits. A record must fit one value, and within a task the lines of one record are held together.

    A carriage return before the end of a record is not part of it; those within quotes stay. A quote that is not closed
    makes one record of the rest of its file.
    """
    text = F.when(F.col("value").startswith("\ufeff"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    kinds = [_ends_inside(F.col("value"), sep, s).alias(c) for c, s in (("outside", False), ("inside", True))]
    marked = lines.select(*block_columns(), text.alias("value")).select("*", *kinds)
    key = F.xxhash64("_file", "_block").alias("key")
    # Only the flags of a line go to Python here.
    summed = marked.select(*_IDS, "_row", "outside", "inside", key).mapInArrow(_summed, f"_task long, _file string, _block long, _length long, {_SUMMARY}")
    blocks = written(_settled(summed))
    placed = with_block(marked, blocks).withColumn("at", F.col("_row") - F.col("first"))
    inside = placed.where((F.col("at") >= F.col("head")) & (F.col("at") < F.col("n") - F.col("tail")))
    number = F.col("base") + F.when(F.col("head") > 0, 1).otherwise(0)
    whole = inside.select("_file", "_block", "_row", "outside", "inside", "value", key, number.alias("number"))
    kind = "_file string, _block long, _row long, line long, value string"
    crossing = placed.where((F.col("at") < F.col("head")) | (F.col("at") >= F.col("n") - F.col("tail")))
    number = F.col("base") + F.when(F.col("at") >= F.col("n") - F.col("tail"), F.col("ends")).otherwise(0)
    parts = crossing.select("_file", number.alias("line"), F.struct("_block", "_row", "value").alias("part"))
    parts = parts.groupBy("_file", "line").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")
    parts = parts.select("_file", F.col("parts")[0]["_block"].alias("_block"), F.col("parts")[0]["_row"].alias("_row"), "line", joined)
    records = whole.mapInArrow(_cut, kind)
    if not blocks.where("head > 0 OR tail > 0").isEmpty():
        records = records.union(parts)
    end = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return records.withColumn("value", end)
