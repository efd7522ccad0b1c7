"""Phrase collocations by Rabin-Karp fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_memory, pick, stored

SLICE = 1 << 20  # bytes of text hashed at once
PENDING = 1 << 20  # fingerprints that a task gathers before it merges equal ones
ROWS = 1 << 16  # of an Arrow batch that leaves a task
BITS = 28  # of the largest bitmap: 32 MB, however many phrases are frequent
SPARE = 256  # bits for each frequent fingerprint below that
LONGEST = 5  # words

_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int = _BASES[0]):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full((2, n), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = self.base, pow(self.base, -1, 1 << 64)
            self.up, self.down = np.cumprod(steps, axis=1)
        return self.up[:n], self.down[:n]


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Of ``values[start:end]``, each from two prefix sums of the polynomial over all values."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """Words of a stretch of text: ``start, end`` bytes, ``doc`` number, ``piece`` number, and a hash by each of ``powers``."""

    def __init__(self, text: np.ndarray, doc_starts: np.ndarray, salts: np.ndarray, powers: list[Powers]):
        self.text, self.powers = text, powers
        kind = _KIND[text]
        inside = kind == 0
        fresh = np.zeros(len(text) + 1, bool)
        fresh[doc_starts] = True
        before = np.r_[False, inside[:-1]]
        after = np.r_[inside[1:], False]
        self.start = np.flatnonzero(inside & (~before | fresh[:-1]))
        self.end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        self.piece = np.cumsum((kind == 2) | fresh[:-1], dtype=np.int32)[self.start]
        self.doc = np.searchsorted(doc_starts, self.start, side="right") - 1
        self.salt = salts[self.doc]
        values = text.astype(np.uint64) + np.uint64(1)
        self.hashes = [_mixed(fingerprints(values, self.start, self.end, p)) for p in powers]

    def phrases(self, n: int, which: int = 0) -> np.ndarray:
        """The fingerprint of the ``n`` words at each place, also where these lie in two pieces."""
        places = max(0, len(self.start) - n + 1)
        at = np.arange(places)
        prints = fingerprints(self.hashes[which], at, at + n, self.powers[which])
        return _mixed(prints ^ self.salt[:places] ^ np.uint64(n * 0xD1B54A32D192ED03 % (1 << 64)))

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words at each place lie in one piece."""
        places = max(0, len(self.start) - n + 1)
        return self.piece[:places] == self.piece[n - 1 : n - 1 + places]

    def numbers(self) -> np.ndarray:
        """A number per word, the same for the same bytes: words of one hash are held against its first word."""
        found, first, number = np.unique(self.hashes[0], return_index=True, return_inverse=True)
        length = self.end - self.start
        same = length == length[first][number]
        step = np.repeat(np.where(same, self.start[first][number] - self.start, 0), length)
        at = np.arange(len(step)) + np.repeat(self.start - np.cumsum(length) + length, length)
        wrong = self.text[at] != self.text[at + step]
        same[np.repeat(np.arange(len(length)), length)[wrong]] = False
        own: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):
            number[i] = len(found) + own.setdefault(self.text[self.start[i] : self.end[i]].tobytes(), len(own))
        return number

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.text[self.start[at] : self.end[at + n - 1]].tobytes().split())


def slices(batch: pa.RecordBatch, powers: list[Powers]) -> Iterator[tuple[Words, int, int]]:
    """Words of a batch's texts, about ``SLICE`` bytes at a time, cut where a text or a piece ends; with the first row and byte."""
    column = batch.column("text")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    text = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    salts = batch.column("salt").to_numpy().view(np.uint64)
    at = 0
    while at < len(text):
        end = _cut(text, offsets, at)
        first, last = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, end, side="left")
        yield Words(text[at:end], np.maximum(offsets[first:last] - at, 0), salts[first:last], powers), int(first), at
        at = end


def _cut(text: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where a slice that begins at ``at`` ends: no word sequence of a piece goes beyond."""
    aim = at + SLICE
    if aim >= len(text):
        return len(text)
    ends = np.flatnonzero(_KIND[text[at:aim]] == 2)[-1:] + at + 1
    best = max(int(offsets[np.searchsorted(offsets, aim, side="right") - 1]), int(ends.max(initial=0)))
    while best <= at:  # a piece longer than a slice
        ends = np.flatnonzero(_KIND[text[aim : aim + SLICE]] == 2)[:1] + aim + 1
        aim += SLICE
        until = int(offsets[np.searchsorted(offsets, at, side="right")])
        best = min([until, *ends.tolist()]) if len(ends) or until <= aim else at
    return best


class Bitmap:
    """Which fingerprints may be frequent: no frequent one is missing."""

    def __init__(self, index: np.ndarray, words: np.ndarray, bits: int):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[index] = words.view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _bitmap(keys: DataFrame) -> Bitmap:
    """Of the column ``key``. At most ``2^(BITS - 6)`` rows reach the driver, however many keys there are."""
    bits = min(BITS, max(16, math.ceil(math.log2(SPARE * max(1, keys.count())))))
    place = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.select(F.shiftright(place, 6).alias("i"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = rows.groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    return Bitmap(rows.column("i").to_numpy(), rows.column("word").to_numpy(), bits)


def _merged(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal fingerprints added up; those of one fingerprint with different checks stay apart."""
    order = np.argsort(keys)
    new, other = _steps(keys, order), _steps(checks, order)
    if (other & ~new).any():
        order = np.lexsort((checks, keys))
        new = _steps(keys, order) | _steps(checks, order)
    first = np.flatnonzero(new)
    return keys[order][first], checks[order][first], np.add.reduceat(counts[order], first) if len(first) else counts, splits[order][first]


def _steps(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where sorted values change, the first place included."""
    values = values[order]
    return np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]


def _counted(n: int, shorter, mask: int):
    """Fingerprints of ``n`` words, how often a task sees them and in which split, where both parts of ``n - 1`` words may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts, held = [Powers(b) for b in _BASES], [], 0

        def gathered() -> list[tuple[np.ndarray, ...]]:
            return [_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))] if parts else []

        def out(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), ROWS):
                key, check, count, split = (c[at : at + ROWS] for c in columns)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key.view(np.int64), check, count, split))], names=["key", "check", "count", "split"])

        with np.errstate(over="ignore"):
            for batch in batches:
                splits = batch.column("split").to_numpy()
                for words, row, _ in slices(batch, powers):
                    fine = words.whole(n)
                    if shorter:
                        may = shorter.value.has(words.phrases(n - 1) & np.uint64(mask))
                        fine &= may[: len(fine)] & may[1:]
                    place = np.flatnonzero(fine)
                    keys = words.phrases(n)[place] & np.uint64(mask)
                    checks = (words.phrases(n, 1)[place] >> np.uint64(33)).astype(np.int32)
                    parts.append(_merged(keys, checks, np.ones(len(keys), np.int64), splits[words.doc[place] + row]))
                    held += len(parts[-1][0])
                    if held > PENDING:
                        parts = gathered()
                        held = len(parts[0][0])
                        if held > PENDING // 2:
                            yield from out(parts[0])
                            parts, held = [], 0
            for columns in gathered():
                yield from out(columns)
        del powers, parts
        free_memory()

    return run


def _written_out(known, longest: int, mask: int):
    """Phrases that this split is to write out, how often a slice has them and where first; with ``n = 0``, its number of words."""

    def rows_of(words: Words, batch: pa.RecordBatch, row: int, begin: int) -> pa.RecordBatch:
        owned, odd = known.value
        number, lang, splits = words.numbers(), batch.column("lang"), batch.column("split").to_numpy()
        split = splits[words.doc + row].view(np.uint64)
        starts = np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :].astype(np.int64)
        docs, counts = np.unique(words.doc, return_counts=True)
        n, texts, total, at = [np.zeros(len(docs), np.int32)], [b""] * len(docs), [counts], [np.searchsorted(words.doc, docs)]
        prints = [np.zeros(len(docs), np.uint64)]
        for size in range(1, longest + 1):
            keys = words.phrases(size) & np.uint64(mask)
            place = np.flatnonzero(words.whole(size) & (owned.has(keys ^ split[: len(keys)]) | odd.has(keys)))
            found, first, group = np.unique(keys[place], return_index=True, return_inverse=True)
            pointer = place[first]
            same = words.salt[place] == words.salt[pointer][group]
            for i in range(size):
                same &= number[place + i] == number[pointer + i][group]
            times = np.bincount(group[same], minlength=len(found))
            own: dict[tuple, list[int]] = {}
            for p in place[~same].tolist():  # another phrase with the fingerprint of the first
                own.setdefault((words.salt[p], *number[p : p + size].tolist()), []).append(p)
            pointer = np.r_[pointer, np.array([x[0] for x in own.values()], np.int64)]
            total.append(np.r_[times, np.array([len(x) for x in own.values()], np.int64)])
            texts += [words.phrase(p, size) for p in pointer.tolist()]
            n.append(np.full(len(pointer), size, np.int32))
            prints.append(keys[pointer])
            at.append(pointer)
        at = np.concatenate(at)
        doc = pa.array(words.doc[at] + row)
        byte = words.start[at] + begin - (starts[words.doc[at] + row] - starts[0])
        columns = [np.concatenate(prints).view(np.int64), lang.take(doc), np.concatenate(n), pa.array(texts, pa.binary()), np.concatenate(total), batch.column("key").take(doc), byte]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["print", "lang", "n", "phrase", "count", "doc", "byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers()]
        with np.errstate(over="ignore"):
            for batch in batches:
                for words, row, begin in slices(batch, powers):
                    if len(words.start):
                        out = rows_of(words, batch, row, begin)
                        for at in range(0, out.num_rows, ROWS):
                            yield out.slice(at, ROWS)
        del powers
        free_memory()

    return run


def frequent_phrases(
    rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 100, longest: int = LONGEST, bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that a language has ``least`` times, and all languages' numbers of words.

    Returns ``lang, n, phrase, count, seen_doc, seen_byte`` (stored; the key of a document that holds the phrase and the byte where it does)
    and ``lang, words``. One scan per length counts 64-bit fingerprints, from prefix polynomials modulo 2^64 over words
    that are themselves such fingerprints of bytes; a task adds up equal ones before they are shuffled. A place counts only
    if the fingerprints of its first and last ``n - 1`` words may be frequent. What is frequent goes to the tasks as a bitmap
    of at most 2^28 bits: it may hold too much, never too little, so its size changes no result.

    With its count each fingerprint carries a pointer, the file split that has it, and 31 bits of a second polynomial, to another
    base down to the bytes. The last scan writes phrases out: of a frequent fingerprint whose checks all agree, only the split of its pointer does, so as
    many rows leave it as there are frequent phrases. Where checks differ, phrases share a fingerprint: every split then writes
    out and counts these by their text. In a slice of text a fingerprint's places are compared, word by word and byte by byte, with its first.

    A null text is empty, a null language ``und``. Repeated rows count as often as they stand there, ties do not matter, and
    further columns are not looked at. A long text is cut at ends of pieces; the memory of a task grows with the longest piece only.
    ``bits`` of a fingerprint that are used can be lowered to see collisions; results stay the same.
    """
    mask = (1 << 64) - (1 << (64 - bits))
    base = pick(rows, key=key, text=text, lang=lang)
    kind = base.schema["key"].dataType.simpleString()
    language = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())  # one value where rows aren't read from files
    base = base.select("key", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), language.alias("lang"), split.alias("split"))
    base = base.withColumn("salt", F.xxhash64("lang"))
    context = rows.sparkSession.sparkContext
    shorter, many = None, []
    for n in range(1, longest + 1):
        counts = base.select("text", "salt", "split").mapInArrow(_counted(n, shorter, mask), "key long, check int, count long, split long")
        sums = counts.groupBy("key").agg(F.sum("count").alias("count"), F.min("split").alias("split"), (F.min("check") < F.max("check")).alias("odd"))
        many.append(stored(sums.where(F.col("count") >= least).withColumn("n", F.lit(n)), "frequent"))
        if shorter:
            shorter.unpersist()
        shorter = context.broadcast(_bitmap(many[-1]))
    shorter.unpersist()
    frequent = many[0]
    for more in many[1:]:
        frequent = frequent.union(more)
    owned = frequent.where("NOT odd").select(F.col("key").bitwiseXOR(F.col("split")).alias("key"))
    known = context.broadcast((_bitmap(owned), _bitmap(frequent.where("odd"))))
    out = base.mapInArrow(_written_out(known, longest, mask), f"print long, lang string, n int, phrase binary, count long, doc {kind}, byte long")
    out = stored(out.withColumn("phrase", F.col("phrase").cast("string")), "written")
    known.unpersist()
    words = stored(out.where("n = 0").groupBy("lang").agg(F.sum("count").alias("words")), "words")
    seen = F.min(F.struct("doc", "byte")).alias("seen")
    told = out.where("n > 0").join(frequent.select(F.col("key").alias("print"), "n", F.col("count").alias("all"), "odd"), ["print", "n"])
    clear = told.where("NOT odd").groupBy("print", "lang", "n", "phrase").agg(F.max("all").alias("count"), seen).drop("print")
    mixed = told.where("odd").groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"), seen).where(F.col("count") >= least)
    phrases = stored(clear.unionByName(mixed).select("lang", "n", "phrase", "count", F.col("seen.doc").alias("seen_doc"), F.col("seen.byte").alias("seen_byte")), "phrases")
    if clear.count() != frequent.where("NOT odd").count():
        raise RuntimeError("the files or their splits changed while they were read")
    return phrases, words


def collocations(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: int = 100,
    top: int = 2000,
    longest: int = LONGEST,
    covered: int = 100,
) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score, seen_doc, seen_byte``.

    A phrase of 2 to ``longest`` words with count ``a`` is cut where ``1000 * a * n / (l * r)``, rounded down, is least, at the first such
    place; ``l`` and ``r`` count the parts, ``n`` the language's words. Phrases inside a longer one that has at least ``covered`` per cent of
    their count are left out; it is enough to look at phrases one word longer, since a phrase between two has a count between theirs.
    Products are decimals of 38 digits. Order: score and ``a`` descending, then the phrase's bytes. See ``frequent_phrases`` for
    nulls, long texts and repeated rows. Without a frequent phrase, and for an empty table, there are no rows.
    """
    phrases, words = frequent_phrases(rows, key, text, lang, least, longest)
    counts = phrases.select("lang", "phrase", F.col("count").alias("a"))
    long = phrases.where("n > 1").select("*", F.split("phrase", " ").alias("w"))
    cuts = long.select("lang", "phrase", F.col("count").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w")).alias("tail"))
    sides = cuts.join(counts.toDF("lang", "head", "l"), ["lang", "head"]).join(counts.toDF("lang", "tail", "r"), ["lang", "tail"])
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('words')}) div ({wide('l')} * {wide('r')})")
    scored = sides.join(words, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where("n > 2").select("lang", "count", F.explode(F.array(part(F.lit(1), F.col("n") - 1), part(F.lit(2), F.col("n")))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("count").alias("within"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within") < covered * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order))
    left = left.where(F.col("rank") <= top)
    left = left.join(phrases.select("lang", "phrase", "seen_doc", "seen_byte"), ["lang", "phrase"])
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "seen_doc", "seen_byte")
