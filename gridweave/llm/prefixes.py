"""Prefix trie of conversations: sorted sequences, their common prefix lengths, and range minima over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

WIDTH = 16  # bytes of a turn's digest
ROWS = 1 << 16  # sequences of a block at most
TURNS = 1 << 19  # turns of a block, about
CHUNK = 1 << 20  # bytes of joined ids that leave a task together
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, turns``: each conversation's turns in order, an array of ``digest`` (32 hex digits of role and text) and ``bytes`` of the text.

    Order: turn, nulls first; turns of one number by digest. A null role or text is empty, so an empty turn is a turn. Rows without a
    key are left out; repeated rows are turns of their own. A conversation is one row of 40 bytes a turn, however long its texts.
    """
    base = pick(rows, key=key, turn=turn, role=role, text=text).where("key IS NOT NULL")
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * WIDTH)
    one = F.struct("turn", digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return base.groupBy(F.col("key").cast("long").alias(key)).agg(turns.alias("turns"))


def branched(turns: DataFrame, base: Column, kept: Column, most: int, key: str = "conv_id") -> DataFrame:
    """Sequences that begin like another one: the first ``kept`` turns (at most ``most``) of conversation ``base``, then one's own after as many.

    ``base`` and ``kept`` are columns over ``key``. An absent base gives no turns. Only ``most`` turns of a base are joined.
    """
    own = turns.select(F.col(key).alias("key"), F.col("turns").alias("own")).select("key", "own")
    named = own.select("key", "own", base.alias("base"), F.least(kept, F.lit(most)).cast("int").alias("kept"))
    heads = own.select(F.col("key").alias("base"), F.slice("own", 1, most).alias("head"))
    joined = named.join(heads, "base", "left")
    none = F.slice("own", 1, 0)
    rest = F.slice("own", F.col("kept") + 1, F.greatest(F.size("own") - F.col("kept"), F.lit(0)))
    return joined.select(F.col("key").alias(key), F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("kept")), none), rest).alias("turns"))


class Minima:
    """Sparse table: minima of ``2^k`` values from each place."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            low, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(low[:-half], low[half:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of ``values[first..last]``, ends included."""
        out = np.empty(len(first), self.rows[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k, row in enumerate(self.rows):
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(row[first[here]], row[last[here] - (1 << k) + 1])
        return out


def extents(minima: Minima, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with row ``at``: a binary search to either side, each prefix for itself.

    ``minima`` are over the common prefix lengths of each row and the one before it.
    """
    rows = len(minima.rows[0])
    left, right = at.copy(), at.copy()
    for k in range(len(minima.rows) - 1, -1, -1):
        row, step = minima.rows[k], 1 << k
        may = np.flatnonzero(right + step < rows)
        may = may[row[right[may] + 1] >= depth[may]]
        right[may] += step
        may = np.flatnonzero(left - step >= 0)
        may = may[row[left[may] - step + 1] >= depth[may]]
        left[may] -= step
    return left, right


def common(paths: list[bytes]) -> np.ndarray:
    """Turns that each path shares with the one before it; 0 for the first."""
    sizes = np.array([len(p) for p in paths], np.int64) // WIDTH
    digests = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(paths), np.int64)
    alive = np.arange(1, len(paths))
    depth = 0
    while len(alive):
        alive = alive[(sizes[alive] > depth) & (sizes[alive - 1] > depth)]
        alive = alive[(digests[begin[alive] + depth] == digests[begin[alive - 1] + depth]).all(axis=1)]
        depth += 1
        out[alive] = depth
    return out


def _nodes(block: pa.Table, edges: pa.Table) -> pa.Table:
    """The nodes of a block of sorted distinct paths, as far as the block sees them.

    What a node adds up is what its rows add, and each row adds what the row before doesn't have, also where that one is
    in the block before; so parts of a node from several blocks can be summed.
    """
    block = block.sort_by("path")
    paths = block.column("path").to_pylist()
    before, after = edges.column("before")[0].as_py(), edges.column("after")[0].as_py()
    copies, least = (block.column(c).to_numpy() for c in ("n", "least"))
    rows = len(paths)
    size = np.array([len(p) for p in paths], np.int64) // WIDTH
    flat = block.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    sums = np.r_[0, np.cumsum(flat)]
    upto = lambda row, depth: sums[begin[row] + depth] - sums[begin[row]]  # noqa: E731  bytes of a row's first turns
    lcp = common(paths)
    back = int(common([before, paths[0]])[1]) if before is not None else -1
    ahead = int(common([paths[-1], after])[1]) if after is not None else -1
    shared = Minima(lcp)
    every = np.arange(rows)

    def listed(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with each depth above ``low`` up to ``high``."""
        many = np.maximum(high - low, 0)
        row = np.repeat(every, many)
        return row, low[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)

    most = np.maximum(lcp, np.r_[lcp[1:], 0])
    row, depth = listed(np.zeros(rows, np.int64), most)
    left, right = extents(shared, row, depth)
    first = left == row
    alone, below = listed(most, size)
    left = np.concatenate([[0], left[first], alone])
    right = np.concatenate([[rows - 1], right[first], alone])
    depth = np.concatenate([[0], depth[first], below])
    above = np.maximum(depth - 1, 0)
    up_left, up_right = extents(shared, left, above)

    total = lambda x: (lambda s: s[right + 1] - s[left])(np.r_[0, np.cumsum(x)])
    number = total(copies)
    whole = upto(every, size)
    new = whole - upto(every, lcp)
    starts = np.where(left == 0, np.maximum(above, back), above)
    starts = np.minimum(starts, size[left])
    distinct = total(new) - new[left] + whole[left] - upto(left, starts)
    saved = total(copies * whole) - number * upto(left, above) - distinct
    leaf = np.r_[lcp[1:], ahead] < size
    stride = int(size.max(initial=0)) + 2
    ranks = np.sort(lcp * rows + every) if rows * stride < 1 << 62 else None
    at = lambda row: np.searchsorted(ranks, depth * rows + row, side="right")
    children = at(right) - at(left) + ((size[left] > depth) & ((left > 0) | (depth >= back)))

    def open_(first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return ((first == 0) & (depth <= back)) | ((last == rows - 1) & (depth <= ahead))

    crosses = open_(left, right, depth)
    up_crosses = open_(up_left, up_right, above) & (depth > 0)
    minima = Minima(least)
    up_least = minima.between(up_left, up_right)
    ends, names = block.column("ends").to_pylist(), block.column("block")[0].as_py()
    prefix = lambda flags, depth: [paths[r][: WIDTH * d] if f else None for f, r, d in zip(flags.tolist(), left.tolist(), depth.tolist(), strict=True)]
    return pa.table(
        {
            "block": pa.array(np.full(len(left), names)),
            "depth": pa.array(depth),
            "least": pa.array(minima.between(left, right)),
            "up": pa.array(up_least, mask=(depth == 0) | up_crosses),
            "n": pa.array(number),
            "children": pa.array(children.astype(np.int64)),
            "leaves": pa.array(total(leaf.astype(np.int64))),
            "saved": pa.array(saved),
            "ends": pa.array([ends[r] if same else None for r, same in zip(left.tolist(), (size[left] == depth).tolist(), strict=True)], pa.string()),
            "key": pa.array(prefix(crosses, depth), pa.binary()),
            "up_key": pa.array(prefix(up_crosses, above), pa.binary()),
        }
    )


_NODE = "block long, depth long, least long, up long, n long, children long, leaves long, saved long, ends string, key binary, up_key binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers blocks of a sorted partition, in the order of partitions."""
    block, rows, turns = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        numbers = []
        for size in batch.column("bytes").value_lengths().to_pylist():
            if rows and (rows >= ROWS or turns + size > TURNS):
                block, rows, turns = block + 1, 0, 0
            rows, turns = rows + 1, turns + size
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "block"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one sequence as text, a megabyte at most."""
    done: list[tuple] = []
    digest, ids, size = None, [], 0
    schema = pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for d, i in zip(batch.column("digest").to_pylist(), batch.column("id").to_pylist(), strict=True):
            if ids and (d != digest or size >= CHUNK):
                done.append((digest, ids[0], len(ids), ",".join(map(str, ids)).encode()))
                ids, size = [], 0
                if len(done) >= 10_000 or done[-1][2] > 10_000:
                    yield out()
            digest = d
            ids.append(i)
            size += len(str(i)) + 1
    if ids:
        done.append((digest, ids[0], len(ids), ",".join(map(str, ids)).encode()))
    if done:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each sequence, chunk after chunk: a task holds one chunk."""
    digest = state = None
    first = number = 0
    schema = pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for d, least, n, text in zip(*[batch.column(c).to_pylist() for c in schema.names[:3]], batch.column("text").to_pylist(), strict=True):
            if state is not None and d == digest:
                state.update(b",")
                state.update(text)
                number += n
                continue
            if state is not None:
                done.append((digest, first, number, state.hexdigest()))
            digest, first, number, state = d, least, n, hashlib.sha256(text)
        if len(done) >= 10_000:
            yield out()
    if state is not None:
        done.append((digest, first, number, state.hexdigest()))
    if done:
        yield out()


def prefix_trie(sequences: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every distinct prefix of sequences (``key, turns`` as from ``turns_of``), down from the empty one, a row each.

    Returns ``key`` (smallest member), ``depth, parent_<key>`` (the parent's smallest member; null for the root), ``n_convs, n_children,
    n_leaves`` (childless prefixes in the subtree, its top included), ``saved_tokens`` (over the subtree, each node's ``n_convs - 1`` times the bytes of its
    last text) and ``ends_sha256`` (of the decimal keys, ascending and joined by commas, of members that end here).

    Equal sequences are one path from the start. Paths, 16 bytes of digest a turn, are sorted over the cluster and cut into blocks
    of bounded size, whichever prefixes they share. In a block, common prefix lengths of neighbours get a sparse table of range minima, and each
    candidate prefix searches its left and right end by itself, without a stack. Counts are differences of prefix sums.
    Prefixes that cross a block's edge are added up by their path; they are as many as blocks, times the turns
    that neighbouring blocks share. No text is sorted or shuffled.

    SHA-256 reads its input in order, so ids of one sequence meet in one task, as text in chunks of a megabyte that tasks
    made before; that task holds one chunk. Keys are whole numbers, each of one row. An empty table gives no rows, not
    even the root; a sequence without turns is a member of the root only.
    """
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    paths = sequences.select(F.col(key).alias("id"), F.unhex(digests).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    paths = stored(paths.withColumn("digest", F.unhex(F.substring(F.sha2("path", 256), 1, 32))), "paths")
    runs = paths.select("digest", "id").repartitionByRange("digest", "id").sortWithinPartitions("digest", "id")
    runs = runs.mapInArrow(_joined, "digest binary, least long, n long, text binary")
    ends = runs.repartition("digest").sortWithinPartitions("digest", "least").mapInArrow(_hashed, "digest binary, least long, n long, ends string")
    distinct = paths.select(F.col("id").alias("least"), "path", "bytes").join(ends.drop("digest"), "least")
    ranked = distinct.select("path", "bytes", "n", "least", "ends").repartitionByRange("path").sortWithinPartitions("path")
    ranked = stored(ranked.mapInArrow(_blocks, "path binary, bytes array<long>, n long, least long, ends string, block long"), "ranked")
    edges = ranked.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("block")  # a row for each block
    edges = edges.select("block", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    nodes = stored(ranked.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_nodes, _NODE), "nodes")
    parts = nodes.where("key IS NOT NULL")
    whole = parts.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("least").alias("least"), F.max("ends").alias("ends"), F.min("depth").alias("depth"), F.min("up_key").alias("up_key")
    )
    whole = stored(whole, "crossing")
    seen = parts.select("block", "key").join(whole.select("key", "least"), "key").select("block", F.col("key").alias("up_key"), F.col("least").alias("up_whole"))
    inside = nodes.where("key IS NULL").join(seen, ["block", "up_key"], "left").withColumn("up", F.coalesce("up", "up_whole"))
    across = whole.join(whole.select(F.col("key").alias("up_key"), F.col("least").alias("up")), "up_key", "left")
    columns = ["least", "depth", "up", "n", "children", "leaves", "saved", "ends"]
    out = inside.select(columns).union(across.select(columns)).withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))
    return out.toDF(key, "depth", f"parent_{key}", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
