"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, pick

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """One row per source with its target, from one row per source with its ``size``.

    Sources in code point order, null last, take the weights in turn. All targets together are
    ``share`` of all sizes. A target stops at ``most`` times its source's size, and the excess goes
    to the others by weight until none is above. With sources in order of the level at which they
    stop, one pass of running sums gives for each the level if all before it are full; the first that is
    not above where its source stops is right, and later ones are smaller.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(turns, ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("room", F.col("size") * most).withColumn("stops_at", F.col("room") / F.col("weight"))
    by_level = Window.orderBy("stops_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("size").over(whole) * F.lit(float(share))
    full = F.coalesce(F.sum("room").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", (budget - full) / left)
    levels = levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("stops_at"), F.col("level"))).over(whole))
    target = F.least(F.col("room").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", F.col("size").alias("source_size"), target.alias("target"))


def size_class(size: Column) -> Column:
    """Classes about 3 % wide, in order of size: bit length and the six highest bits."""
    bits = F.length(F.bin(size))
    return bits * 64 + F.call_function("shiftright", size, F.greatest(bits - 6, F.lit(0)))


def salt_of(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % SALTS


def hex_fraction(text: Column) -> Column:
    """A fraction in [0, 1) from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_sources(
    rows: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each row: ``key, size, source_size, target, copies, taken, row``.

    ``row`` is the whole input row, so that a caller can emit it ``copies`` times without a join and
    whatever its columns are called. Every row of a source expects target / source_size copies. Its
    place in the source, times that, plus one offset per source, is a prefix sum; the row is taken
    once per integer that the sum passes. Rows stand in order of size, so the words taken come near the
    target, not only the number of rows.

    A place is the number of rows in earlier cells plus the place in the cell. Cells split a source by
    size class and a hash of the key, so a source with most of the rows, or many rows of one size, is
    spread over tasks, and the running sum is over cells. The size must be a whole number; null counts
    as 0. A null source is a source of its own. Sources of size 0 get a target of 0 and are not taken.
    Repeated rows are rows of their own. An empty table gives an empty result.
    """
    pick(rows, key=key, source=source, size=size)
    known = F.greatest(F.coalesce(named(size).cast("long"), F.lit(0)), F.lit(0))
    cells = [F.col("source"), F.col("class"), F.col("salt")]
    placed = rows.select(
        named(key).alias("key"), named(source).alias("source"), known.alias("size"), F.struct(*[named(c) for c in rows.columns]).alias("row")
    ).withColumns({"class": size_class(F.col("size")), "salt": salt_of(F.col("key"))})
    totals = placed.groupBy(*cells).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sources = source_targets(totals.groupBy("source").agg(F.sum("words").alias("size")), weights, share, most)
    order = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*cells, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    offset = hex_fraction(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    sources = sources.select(
        F.col("source").alias("of"), "source_size", "target", offset.alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"),
    )
    ahead = ahead.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ahead = ahead.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("salt").alias("h"), "ahead", "source_size", "target", "offset", "expected")
    in_cell = Window.partitionBy(*cells).orderBy("size", "key")
    numbered = placed.withColumn("place", F.row_number().over(in_cell))
    joined = numbered.join(
        ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("salt") == F.col("h"))
    )
    until = lambda n: F.floor(F.col("expected") * n + F.col("offset"))
    last = F.col("ahead") + F.col("place")
    copies = (until(last) - until(last - 1)).cast("long")
    return joined.select(
        F.col("key"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row"
    ).withColumnRenamed("key", key)


def take(mixed: DataFrame) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
