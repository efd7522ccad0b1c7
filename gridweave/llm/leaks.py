"""Benchmark decontamination by a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import named, pick, stored

WINDOW = 10  # words
BLOCK = 1 << 18  # words of items in one automaton, about
PIECE = 1 << 14  # words of a long item that stay together
CHUNK = 1 << 20  # bytes of a text that are split into words at once

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> Iterator[bytes]:
    """Lower-case words: runs of ASCII letters, digits and characters beyond ASCII. Only ``A-Z`` are lowered."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and _WORD.match(text[end : end + 1].lower()):
            end += 1
        yield from _WORD.findall(text[at:end].lower())
        at = end


class Automaton:
    """Suffix automaton of several word sequences, of which any run of ``window`` words, or a shorter sequence as a whole, is wanted.

    ``link`` and ``length`` are those of suffix automata; ``step`` maps ``state * words + word`` to the next state. ``gate`` leads
    from a state to the one that holds its suffix of ``window`` words (0: none), ``short`` to the longest wanted shorter
    sequence that ends it (0: none). ``items`` lists the sequences that hold a gate's window or are a short one's words.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes], int]], window: int = WINDOW):
        """Items are ``(id, words, words of the whole item)``: a part of a long item is never a short sequence."""
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.shortest = [0], [-1], window
        follow: list[dict[int, int]] = [{}]
        ends: dict[int, set] = {}
        paths = []
        for name, text, whole in items:
            if not text:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text]
            last, states = 0, []
            for word in numbers:
                last = self._grown(follow, last, word)
                states.append(last)
            paths.append((name, states, whole))
        self.gate, self.short = [0] * len(follow), [0] * len(follow)
        order = sorted(range(1, len(follow)), key=self.length.__getitem__)
        shorts = {states[-1] for _, states, whole in paths if whole < window}
        for state in order:
            up = self.link[state]
            if self.length[state] >= window:
                self.gate[state] = state if self.length[up] < window else self.gate[up]
            self.short[state] = state if state in shorts else self.short[up]
        for name, states, whole in paths:
            if whole < window:
                ends.setdefault(states[-1], set()).add(name)
                self.shortest = min(self.shortest, whole)
            for state in states[window - 1 :] if whole >= window else []:
                ends.setdefault(self.gate[state], set()).add(name)
        self.items = {state: sorted(x for x in names if x is not None) for state, names in ends.items()}
        width = max(1, len(self.vocabulary))
        self.step = {state * width + word: to for state, out in enumerate(follow) for word, to in out.items()}

    def _grown(self, follow: list[dict[int, int]], last: int, word: int) -> int:
        """The state of the sequence read so far and one more word; sequences share states, so one may be there already."""
        if word in follow[last]:
            to = follow[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._split(follow, last, word, to)
        new = self._added(follow, self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = follow[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(follow, at, word, to)
        return new

    def _added(self, follow: list[dict[int, int]], length: int, out: dict[int, int], link: int) -> int:
        follow.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(follow) - 1

    def _split(self, follow: list[dict[int, int]], at: int, word: int, to: int) -> int:
        """A state for the shorter sequences of ``to``, which end in more places than its longest."""
        new = self._added(follow, self.length[at] + 1, dict(follow[to]), self.link[to])
        self.link[to] = new
        while at >= 0 and follow[at].get(word) == to:
            follow[at][word] = new
            at = self.link[at]
        return new

    def dumped(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def loaded(cls, data: bytes) -> Automaton:
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(data))
        return out

    def hits(self, text: bytes) -> tuple[int, list[int], list[int], set[str]]:
        """Number of words; first and last word of each maximal run that is hit; the items."""
        get, unknown = self.vocabulary.get, -1
        numbers = [np.fromiter((get(w, unknown) for w in part), np.int32) for part in _parts(text)]
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        edge = np.flatnonzero(np.diff(np.r_[False, numbers >= 0, False].astype(np.int8)))
        first: list[int] = []
        last: list[int] = []
        states: set[int] = set()
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:  # an unknown word ends every match, so a shorter run holds no wanted sequence
                self._stream(numbers[begin:end].tolist(), begin, first, last, states)
        return len(numbers), first, last, {name for s in states for name in self.items[s]}

    def _stream(self, numbers: list[int], begin: int, first: list[int], last: list[int], states: set[int]) -> None:
        """Follows a run of known words, with the longest match that ends at each."""
        step, link, length, gate, short = self.step.get, self.link, self.length, self.gate, self.short
        width, window = len(self.vocabulary), self.window
        state = matched = 0
        for at, word in enumerate(numbers, begin):
            to = step(state * width + word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step(state * width + word)
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            size = 0
            if matched >= window:
                states.add(gate[state])
                size = window
            end = short[state]
            while end:  # suffixes of the match only
                if length[end] <= matched:
                    states.add(end)
                    size = max(size, length[end])
                end = short[link[end]]
            if size:
                begin_hit = at - size + 1
                while first and begin_hit <= last[-1] + 1 and begin_hit < first[-1]:
                    begin_hit = min(begin_hit, first.pop())
                    last.pop()
                if first and begin_hit <= last[-1] + 1:
                    last[-1] = at
                else:
                    first.append(begin_hit)
                    last.append(at)


def _parts(text: bytes) -> Iterator[list[bytes]]:
    found: list[bytes] = []
    for word in words_of(text):
        found.append(word)
        if len(found) == 1 << 16:
            yield found
            found = []
    if found:
        yield found


def _item_parts(window: int):
    """Items as words, joined by blanks; long ones in parts that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = list(words_of(text))
                parts = [words[at : at + PIECE + window - 1] for at in range(0, max(1, len(words) - window + 1), PIECE)] if words else []
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array([name] * len(parts), pa.string()),
                        "part": pa.array(range(len(parts)), pa.int64()),
                        "words": pa.array([b" ".join(p) for p in parts], pa.binary()),
                        "n": pa.array([len(p) for p in parts], pa.int64()),
                        "whole": pa.array([len(words)] * len(parts), pa.int64()),
                    }
                )

    return run


def _built(window: int):
    def run(table: pa.Table) -> pa.Table:
        items = [(x["item"], x["words"].split(b" "), x["whole"]) for x in table.select(["item", "words", "whole"]).to_pylist()]
        data = pa.array([Automaton(items, window).dumped()], pa.binary())
        return pa.table({"block": table.column("block").slice(0, 1), "data": data})

    return run


def automata(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, int]:
    """A table of pickled automata, ``block, data``, each of about ``BLOCK`` words of the items, and their number. They are built in tasks."""
    base = pick(items, item=key, text=text).select(F.col("item").cast("string").alias("item"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    parts = base.distinct().mapInArrow(_item_parts(window), "item string, part long, words binary, n long, whole long")
    parts = stored(parts, "items")
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK) if total > BLOCK else 1)
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item", "part", "words"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(_built(window), "block int, data binary"), "automata"), blocks


_MATCHES = StructType(
    [
        StructField("row", LongType()),
        StructField("n_words", LongType()),
        StructField("first", ArrayType(IntegerType())),
        StructField("last", ArrayType(IntegerType())),
        StructField("items", ArrayType(StringType())),
    ]
)


def _matched(data):
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.loaded(data.value)
        for batch in batches:
            found = [automaton.hits(text.as_py()) for text in batch.column("text")]
            found = [(n, first, last, sorted(items)) for n, first, last, items in found]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            rest = [c for c in batch.schema.names if c not in ("row", "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, *map(batch.column, rest)], names=[*_MATCHES.names, *rest])

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
) -> DataFrame:
    """What each row of ``docs`` shares with the items: ``row, n_words, spans, n_hit, items``.

    ``row`` is a struct of the row's columns (those of ``carry``, if given), ``spans`` an array of ``first, last`` word numbers of maximal runs of hit words,
    ``items`` the distinct ids as strings in byte order. A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or
    of all words of a shorter one.

    The items' words are one generalised suffix automaton, which tasks stream every text through, keeping the longest match that
    ends at each word. Items of more than ``BLOCK`` words in all are dealt to several automata, each broadcast
    in turn and streamed by all texts (long items in overlapping parts), and a text's spans are united afterwards; so neither what is broadcast nor
    what a task holds grows with the items. Documents are not shuffled for one automaton; for more, spans are.

    A null or empty text, on either side, has no words. An item without an id marks words but isn't listed. Repeated rows of documents
    are judged one by one, repeated items once. A long text is split into words by the megabyte. Without
    items nothing is hit; without documents there are no rows. Further columns, whatever their names, stay in ``row``.
    """
    built, blocks = automata(items, item_key, item_text, window)
    whole = F.struct(*[named(c).alias(c) for c in carry or docs.columns]).alias("whole")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(named(text).cast("binary"), F.lit(b"")).alias("text"), whole)
    if blocks > 1:  # several scans have to agree on the numbers
        base = stored(base, "numbered")
    context = docs.sparkSession.sparkContext
    out = None
    for block in range(blocks):
        found = built.where(F.col("block") == block).select("data").first()
        data = context.broadcast(bytes(found["data"]) if found else Automaton([], window).dumped())
        if blocks == 1:
            out = base.mapInArrow(_matched(data), StructType([*_MATCHES, base.schema["whole"]]))
        else:
            seen = base.select("row", "text").mapInArrow(_matched(data), _MATCHES)
            out = seen if out is None else out.union(seen)
    if blocks > 1:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last", "items")]
        out = out.groupBy("row").agg(F.max("n_words").alias("n_words"), *joined).join(base.select("row", "whole"), "row")
    spans = F.transform(F.arrays_zip("first", "last"), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    spans = spans if blocks == 1 else _united(F.array_sort(spans))
    out = out.select(F.col("whole").alias("row"), "n_words", spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"] + 1))
    return out.select("row", "n_words", "spans", hit.alias("n_hit"), "items")


def _united(spans):
    """Sorted spans, with those that overlap or touch joined."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def joined(done, span):
        top = F.element_at(done, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))
        meets = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, none, joined)


def remove_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", most_words: int = 0, most_share: float = 0.5, window: int = WINDOW, **keys: str
) -> DataFrame:
    """Documents without what they share with test items: the columns of ``docs``, the text cut.

    Spans of hit words that are longer than ``most_words`` go, from the first byte of their first word to the last of their last; a document
    of which more than ``most_share`` of the words are hit goes as a whole. Other documents stay as they are, null texts included.
    """
    found = find_leaks(docs, items, text=text, window=window, **keys)
    kept = found.where(F.col("n_hit") <= most_share * F.col("n_words"))
    long = F.filter("spans", lambda s: s["last"] - s["first"] + 1 > most_words)
    kept = kept.select("row", F.col("row").getField(text).cast("binary").alias("text"), long.alias("spans"))
    cut = kept.mapInArrow(_without_spans, StructType([kept.schema["row"], StructField("text", BinaryType())]))
    return cut.select(*[(F.col("text").cast("string") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans").to_pylist()
        out = [t if not s else cut_spans(t, s) for t, s in zip(texts.to_pylist(), spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=["row", "text"])


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    low = text.lower()
    kept, at, number, wanted = [], 0, -1, iter(spans)
    span, begin = next(wanted), 0
    for word in _WORD.finditer(low):
        number += 1
        if number == span["first"]:
            begin = word.start()
        if number == span["last"]:
            kept.append(text[at:begin])
            at = word.end()
            span = next(wanted, None)
            if span is None:
                break
    return b"".join([*kept, text[at:]])
