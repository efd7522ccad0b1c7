"""Near-duplicates by order MinHash and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_memory, pick, stored
from .components import components, joined

WORDS = 3  # of a k-mer
PICKED = 2  # k-mers of a sketch
SKETCHES = 48
THRESHOLD = 0.8
MOST_BROADCAST = 500_000  # digests of candidates that are broadcast, 72 bytes each
FIRST = 16  # one bucket in so many is compared with its leader first
TURNS = 2  # of leaders for components of a bucket, before all open pairs are looked at
SMALL = 16  # likeliest pairs of two components in a bucket, aligned before all others
TILE = 1024  # members of a crowded bucket that are set against as many others at once
PAIRS = 1 << 20  # of members looked at together
BINS = 512  # of a bag of words
TOGETHER = 256  # pairs aligned at once
NARROW = 8  # band that is tried first
CELLS = 1 << 21  # of a band matrix row for all pairs aligned at once, at most
FAR = np.int32(1 << 29)

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray, size: int = WORDS, picked: int = PICKED, sketches: int = SKETCHES) -> np.ndarray:
    """One number per sketch, from hashes of a text's words in order.

    A sketch draws the ``picked`` k-mers with the smallest hashes and hashes them in text order. The hash that is
    drawn by also takes in which occurrence of the k-mer it is, so a repeated k-mer counts as often as it stands there.
    Texts are padded at both ends, so each word is in ``size`` k-mers. Texts with few k-mers are drawn whole.
    """
    pad = np.ones(size - 1, np.uint64)
    words = np.concatenate([pad, words.astype(np.uint64), pad])
    n = len(words) - size + 1
    grams = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        grams = _mixed(grams * np.uint64(31) + words[i : i + n])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    run = np.repeat(first, np.diff(np.r_[first, n]))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - run).astype(np.uint64)
    labelled = _mixed(grams + occurrence * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty(sketches, np.uint64)
    at_once = max(1, min(sketches, CELLS // n))
    for s in range(0, sketches, at_once):
        seeds = _SEEDS[s : min(s + at_once, sketches)]
        drawn = labelled[None, :] * (seeds[:, None] | np.uint64(1)) + seeds[:, None]
        if n > picked:
            at = np.empty((len(seeds), picked), np.int64)
            for i in range(picked):
                at[:, i] = drawn.argmin(axis=1)
                drawn[np.arange(len(seeds)), at[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at.sort(axis=1)
        else:
            at = np.tile(np.arange(n), (len(seeds), 1))
        key = seeds.copy()
        for i in range(at.shape[1]):
            key = key * np.uint64(0x100000001B3) ^ grams[at[:, i]]
        out[s : s + len(seeds)] = key
    return _mixed(out).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            words = batch.column("words")
            flat, ends = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
            keys = [sketch(flat[a:b].view(np.uint64)).tolist() if b > a else [] for a, b in zip(ends, ends[1:], strict=False)]
            bags = [bag(flat[a:b].view(np.uint64)).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            sizes = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), sizes, pa.array(keys, pa.list_(pa.int64())), pa.array(bags, pa.binary())],
                names=["id", "digest", "n", "keys", "bag"],
            )
    free_memory()


def bag(words: np.ndarray) -> np.ndarray:
    """How many words of a text fall in each of ``BINS`` bins by their hash, up to 255."""
    return np.minimum(np.bincount((words >> np.uint64(55)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def least_edits(bags: np.ndarray, others: np.ndarray, n: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Twice a lower bound of edit distances: the longer text less the words in common, which bins can only make more."""
    out = np.abs(n - n_others)
    for at in range(0, len(bags), 1 << 13):
        part = slice(at, at + (1 << 13))
        out[part] += np.abs(bags[part].astype(np.int16) - others[part]).sum(1, dtype=np.int64)
    return out


def _most_edits(n: np.ndarray, n_others: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(np.maximum(n, n_others) * (1 - threshold) + 1e-9).astype(np.int64)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of word sequences by paths inside a band: exact up to ``band``, else an upper bound of the distance.

    One row of the band of all pairs at a time; pairs that have ended leave. Cells hold the distance less their place in the band,
    so what comes from the left in a row is a running minimum.
    """
    result = np.full(len(pairs), FAR, np.int64)
    n = np.array([len(a) for a, _ in pairs], np.int64)
    end = np.array([len(b) for _, b in pairs], np.int64) - n + band
    width = 2 * band + 1
    live = np.flatnonzero((end >= 0) & (end < width))
    live = live[np.argsort(n[live], kind="stable")]
    n, end = n[live], end[live]
    high = int(n.max(initial=0))
    a = np.full((len(live), high + 1), -1, np.int32)
    b = np.full((len(live), high + width + 1), -2, np.int32)
    for p, number in enumerate(live):
        x, y = pairs[number]
        a[p, : len(x)] = x
        y = y[: high + band + 1]
        b[p, band : band + len(y)] = y
    steps = np.arange(width, dtype=np.int32)
    row = np.tile(np.where(steps >= band, np.int32(-band), FAR), (len(live), 1))
    first = 0  # pairs before it have ended
    for i in range(high + 1):
        if i:
            new = row + (a[first:, i - 1 : i] != b[first:, i - 1 : i - 1 + width])
            np.minimum(new[:, :-1], row[:, 1:] + 2, out=new[:, :-1])
            row = np.minimum.accumulate(new, axis=1, out=new)
        ended = first
        while ended < len(n) and n[ended] == i:
            ended += 1
        if ended > first:
            here = end[first:ended]
            result[live[first:ended]] = row[np.arange(ended - first), here] + here
            row, first = row[ended - first :], ended
    return result


def align(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> np.ndarray:
    """How far pairs are apart: a share of the longer length that bounds their edit distance, or 1 if it is above the threshold.

    Words, and pairs of words, that the two don't share bound the distance from below and settle most unlike pairs. The band
    starts narrow: any path in it within the threshold is proof enough. It widens to the threshold for pairs that need it.
    """
    out = np.ones(len(pairs))
    longest = np.array([max(len(a), len(b), 1) for a, b in pairs])
    most = np.floor(longest * (1 - threshold) + 1e-9).astype(int)
    left = np.array([p for p, (a, b) in enumerate(pairs) if _may_reach(a, b, int(most[p]))], np.int64)
    left = left[np.argsort(longest[left], kind="stable")]
    width = NARROW
    while len(left):
        unsettled = [np.zeros(0, np.int64)]
        at = 0
        while at < len(left):
            group = left[at : at + TOGETHER]
            while len(group) > 1 and len(group) * max(2 * min(width, most[group].max()) + 1, longest[group[-1]] // 8) > CELLS:
                group = group[: len(group) // 2]
            band = int(min(width, most[group].max()))
            d = distances([pairs[p] for p in group], band)
            fine = d <= most[group]
            out[group[fine]] = d[fine] / longest[group[fine]]
            unsettled.append(group[~fine & (band < most[group])])
            at += len(group)
        left = np.concatenate(unsettled)
        width *= 4
    return out


def _may_reach(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the words and pairs of words in common allow a distance of ``most``; an edit changes two pairs at most."""
    longest = max(len(a), len(b))
    if longest - _shared(a, b) > most:
        return False
    if longest < 2:
        return True
    joined = np.unique(np.concatenate([x[:-1].astype(np.int64) << 32 | x[1:] for x in (a, b)]), return_inverse=True)[1]
    cut = max(0, len(a) - 1)
    return longest - 1 - _shared(joined[:cut], joined[cut:]) <= 2 * most


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, counted as often as both have them."""
    n = int(max(a.max(initial=0), b.max(initial=0))) + 1
    return int(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)).sum())


def _aligned(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gap", pa.float64())])

    def numbered(texts: set[str | None]) -> dict[str | None, np.ndarray]:
        number: dict[str, int] = {}
        return {t: np.array([number.setdefault(w, len(number)) for w in _WORD.findall((t or "").lower())], np.int32) for t in texts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                left, right = piece.column("left").to_pylist(), piece.column("right").to_pylist()
                words = numbered({*left, *right})
                gaps = align([(words[x], words[y]) for x, y in zip(left, right, strict=True)], threshold)
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(gaps)], schema=schema)
        free_memory()

    return run


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b, gap`` of pairs of members, from whole texts; only texts in a pair move. A text in very many pairs is joined last, as a skewed join."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(known, "id")
    wanted = stored(wanted, "candidates")
    small = wanted.count() <= MOST_BROADCAST
    moved = texts.select("digest", "text").join(F.broadcast(wanted) if small else wanted, "digest")
    moved = stored(moved.groupBy("id").agg(F.first("text").alias("text")), "texts")
    right = pairs.join(moved.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(moved.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    return stored(both.select("a", "b", "left", "right").mapInArrow(_aligned(threshold), "a long, b long, gap double"), "gaps")


def _words(text: Column) -> Column:
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def near_copies(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The class of each document: ``key, class_id, class_size, kept, digest``.

    Texts link if the edit distance of their words, over the longer length, is at most ``1 - threshold``. A class
    is what links connect; its id is its smallest key, and that document is kept. ``digest`` is the text's SHA-256.

    Candidates share one of ``SKETCHES`` sketches. Each draws the ``PICKED`` k-mers of ``WORDS`` words with the smallest hashes, which also take in the
    occurrence of a repeated k-mer, and keeps them in the order of the text, ends padded. Two texts agree in a sketch with about the square of
    the Jaccard similarity of their k-mers. At a fifth of words edited that is 0.35 if edits are scattered, 0.25 if they are evenly spaced, the worst for
    three words: candidates with probability 0.998 and 0.95.

    All candidates that no other links connect are settled, so classes are the components of all links between candidates, whatever
    the order of the search. Equal texts are one member from the start and never paired. One bucket in ``FIRST`` first draws a leader by a
    hash of bucket and member, and all in it are compared with the leader; so most of a class, however large, is one component after few
    pairs. ``TURNS`` times, leaders are then drawn in every bucket that holds several components, one member stands for each component there, and these are
    compared with the leader. What is left in a bucket is judged by a bound that needs no text: lengths, and words in common by
    ``BINS`` bins, allow for the threshold or not; of two components the ``SMALL`` likeliest pairs are aligned, then all left between different ones.
    Crowded buckets are dealt in tiles of about ``TILE``, so no task holds one whole; the pairs that the bound looks at grow with the square
    of what lies in a bucket and isn't connected. Aligning needs memory for one band row, however long the texts are.

    Keys are whole numbers. Rows with a null key or a text without words are kept and in no class with others (class_id:
    the key). Rows are judged by key and text: repeated rows get equal results, and rows of one key with unlike texts are members of their own, of
    which each can be kept. Further columns are not looked at. An empty table gives an empty result.
    """
    base = pick(rows, id=key, text=text).select(F.col("id").cast("long").alias("id"), "text", F.sha2("text", 256).alias("digest"))
    texts = base.where(F.col("id").isNotNull() & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    seen = texts.select("id", "digest", _words(F.col("text")).alias("words"))
    seen = stored(seen.mapInArrow(_sketched, "id long, digest string, n long, keys array<long>, bag binary"), "sketches")
    copies = seen.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    parts = seen.groupBy("digest").agg(F.min("n").alias("n"), F.min_by("keys", "id").alias("keys"), F.min("bag").alias("bag"))
    members = stored(copies.join(parts, "digest").select(F.monotonically_increasing_id().alias("id"), "*"), "members")
    bags = members.select("id", "n", "bag")
    keyed = members.select("id", "n", "bag", "keys")
    buckets = members.select("id", "n", F.explode("keys").alias("bucket"))
    filed = stored(_led(buckets, ["bucket"]), "buckets")
    known = members.select("id", "digest")
    part = filed.where(F.pmod("bucket", F.lit(FIRST)) == 0)
    gaps = _verified(stored(_allowed(_with_leader(part, threshold), bags, threshold), "pairs"), known, texts, threshold)
    found = stored(components(_linked(gaps, threshold)), "found")
    for turn in range(TURNS + 2):
        if turn < TURNS:
            pairs = _allowed(_between_leaders(filed, found, turn, threshold), bags, threshold)
        else:
            pairs = _open_pairs(filed, found, keyed, SMALL if turn == TURNS else None, threshold)
        pairs = stored(pairs.join(gaps.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        more = _verified(pairs, known, texts, threshold)
        found = stored(joined(found, _linked(more, threshold)), "found")
        gaps = gaps.union(more)
    classes = members.join(found, F.col("id") == F.col("node"), "left")
    classes = stored(classes.select("digest", "least", "copies", F.coalesce("component", "id").alias("class")), "classes")
    sizes = classes.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    # Of several texts of the smallest key, one is kept.
    first = F.min(F.struct("least", "digest"))
    sizes = sizes.join(classes.groupBy("class").agg(first["digest"].alias("first")), "class")
    classes = classes.join(sizes, "class").select("digest", "class_id", "class_size", (F.col("digest") == F.col("first")).alias("leads"))
    out = base.select("id", "digest", (F.col("id").isNotNull() & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("own"))
    out = out.join(classes, "digest", "left")
    own = F.col("own") & F.col("class_id").isNotNull()
    return out.select(
        F.col("id").alias(key),
        F.when(own, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(own, F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
        (~own | (F.col("leads") & (F.col("class_id") == F.col("id")))).alias("kept"),
        "digest",
    )


def _draw(*key: str) -> Column:
    """A member's draw for the lead of a bucket: another one in each bucket."""
    return F.struct(F.xxhash64("id", *key).alias("draw"), "id", "n")


def _led(rows: DataFrame, key: list[str]) -> DataFrame:
    """Members of buckets (``id, n`` and the bucket's key) with ``leader`` and ``n_leader``; members alone in a bucket are left out."""
    leaders = rows.groupBy(*key).agg(F.min(_draw(*key)).alias("l"), F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    return rows.join(leaders.select(*key, F.col("l.id").alias("leader"), F.col("l.n").alias("n_leader")), key)


def _alike_in_length(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def _with_leader(led: DataFrame, threshold: float) -> DataFrame:
    pairs = led.where((F.col("id") != F.col("leader")) & _alike_in_length("n", "n_leader", threshold))
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _linked(gaps: DataFrame, threshold: float) -> DataFrame:
    return gaps.where(F.col("gap") <= 1 - threshold + 1e-12).select("a", "b")


def _placed(filed: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with their component."""
    own = found.select(F.col("node").alias("id"), F.col("component").alias("own"))
    return filed.select("bucket", "id", "n").join(own, "id", "left").withColumn("own", F.coalesce("own", "id"))


def _between_leaders(filed: DataFrame, found: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Pairs of a bucket's leader, drawn anew each turn, and one member of each other component there."""
    draw = F.struct(F.xxhash64("bucket", "id", F.lit(turn)).alias("draw"), "id", "n")
    ones = stored(_placed(filed, found).groupBy("bucket", "own").agg(F.min(draw).alias("m")), "standing")
    leaders = ones.groupBy("bucket").agg(F.min(F.struct("m", "own")).alias("l"), F.count("*").alias("own_count")).where("own_count > 1")
    both = ones.join(leaders.select("bucket", "l"), "bucket").where(F.col("own") != F.col("l.own"))
    both = both.select(F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("l.m.id").alias("leader"), F.col("l.m.n").alias("n_leader"))
    return _with_leader(both, threshold)


def _allowed(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` that lengths and bags of words allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, others = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            fine = least_edits(_bags(batch.column("bag_a")), _bags(batch.column("bag_b")), n, others) <= 2 * _most_edits(n, others, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    side = lambda s: bags.select(*[F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in ("id", "n", "bag")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _bags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def _first_met(keys: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bucket that members ``i`` and ``j`` meet in is the smallest that both lie in, so each pair counts once.

    Keys of different sketches that happen to be equal don't count; pairs that meet by them only are kept.
    """
    fine = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 13):
        part = slice(at, at + (1 << 13))
        own = keys[i[part]]
        same = own == keys[j[part]]
        least = np.where(same, own, np.iinfo(np.int64).max).min(axis=1)
        fine[part] = (least == bucket[i[part]]) | ~same.any(axis=1)
    return fine


def _open_pairs(filed: DataFrame, found: DataFrame, bags: DataFrame, most: int | None, threshold: float) -> DataFrame:
    """Allowed pairs of texts in one bucket that no links connect so far: all, or about the ``most`` likeliest for two components.

    Where ``bags`` also has the members' ``keys``, a pair comes out of one of its buckets only.
    """
    placed = stored(_placed(filed, found).drop("n"), "placed")
    several = placed.groupBy("bucket").agg(F.count("*").alias("crowd"), F.min("own").alias("least"), F.max("own").alias("last")).where("least < last")
    several = several.select("bucket", F.ceil(F.col("crowd") / TILE).cast("int").alias("tiles"))
    dealt = placed.join(several, "bucket").join(bags, "id").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cell = ["bucket", "low", "high"]
    dealt = dealt.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "own", *bags.columns)
    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_crossed(most, threshold), "a long, b long").distinct()


def _crossed(most: int | None, threshold: float):
    """Allowed pairs of different components in each cell of rows sorted by cells."""

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, low, high, tile, ids, n, own = (rows.column(c).to_numpy() for c in ("bucket", "low", "high", "tile", "id", "n", "own"))
        bags = _bags(rows.column("bag"))
        keys = _keys(rows.column("keys")) if "keys" in rows.column_names else None
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        cell = np.cumsum(new) - 1
        after = np.r_[np.flatnonzero(new)[1:], len(ids)][cell] - np.arange(len(ids)) - 1  # members of the cell that follow
        steps = np.cumsum(after)
        at = 0
        while at < len(ids):
            until = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + PAIRS, side="right")))
            count = after[at:until]
            i = np.repeat(np.arange(at, until), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            at = until
            keep = (own[i] != own[j]) & ((low[i] == high[i]) | (tile[i] != tile[j]))
            keep &= np.abs(n[i] - n[j]) <= _most_edits(n[i], n[j], threshold)
            i, j = i[keep], j[keep]
            edits = np.zeros(len(i), np.int64)
            for k in range(0, len(i), 1 << 13):
                a, b = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                edits[k : k + len(a)] = least_edits(bags[a], bags[b], n[a], n[b])
            keep = edits <= 2 * _most_edits(n[i], n[j], threshold)
            i, j, edits = i[keep], j[keep], edits[keep]
            if keys is not None:
                keep = _first_met(keys, bucket, i, j)
                i, j, edits = i[keep], j[keep], edits[keep]
            if most is not None and len(i) > most:
                ends = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                order = np.lexsort((edits, *ends, cell[i]))
                i, j, sorted_by = i[order], j[order], [x[order] for x in (*ends, cell[i])]
                first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)])
                rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                i, j = i[rank < most], j[rank < most]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch])
            keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            whole = int(np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)).max(initial=-1)) + 1  # rows before the last cell
            if whole:
                yield from pairs_of(rows.slice(0, whole))
            rest = rows.slice(whole).to_batches()
        if rest:
            yield from pairs_of(pa.Table.from_batches(rest))
        free_memory()

    return run
