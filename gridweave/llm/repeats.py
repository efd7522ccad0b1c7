"""Removal of long strings repeated across documents, on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import free_memory, named, pick

LENGTH = 50
GRAM = 20
BATCH_BYTES = 8 << 20  # of text that one group holds on average
BUCKET_BYTES = 4 << 20  # of text whose anchors one bucket holds on average
CHUNK = 1 << 18  # bytes worked on at once
NO_KEY = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_powers: dict[str, np.ndarray] = {}  # of a chunk, for as long as a group is worked on


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _slide(x: np.ndarray, width: int, pick_one: Callable) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick_one(x[:-step], x[step:])
        done += step
    return x


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of documents that lie end to end: their places, hashes of their grams, and of their surroundings.

    Of the grams in each ``length`` bytes, those with the smallest hash are anchors, so equal strings of that length have
    equal anchors at equal places. The surroundings are what strings of that length over the anchor can reach, cut at the
    document's ends. Returns ``at, gram hash, surroundings' hash, left, right``, places counted from the start of ``text``.
    """
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    up, down = _power(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * up[:-1], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
    across = (ends[:-1, None] - np.arange(1, gram)[None, :]).ravel()
    grams[across[(across >= 0) & (across < len(grams))]] = np.uint64(2**64 - 1)
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _slide(np.concatenate([edge, least, edge]), width, np.maximum))
    starts = np.concatenate([[0], ends[:-1]])
    of = np.searchsorted(ends, at, side="right")
    at = at[(ends[of] - starts[of] >= length) & (at + gram <= ends[of])]
    of = np.searchsorted(ends, at, side="right")
    left = np.maximum(starts[of], at - (length - gram))
    right = np.minimum(ends[of], at + length)
    around = _mix((sums[right] - sums[left]) * down[left] + ((at - left) * 256 + (right - at)).astype(np.uint64) * np.uint64(_BASE))
    return at, grams[at], around & ~np.uint64(1), left, right


def _freed(work: Callable) -> Callable:
    """A group's function that leaves nothing of its memory to the worker's next stage."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return work(*tables)
        finally:
            _powers.clear()
            free_memory()

    if len(inspect.signature(work).parameters) == 2:
        return lambda one, two: run(one, two)
    return lambda one: run(one)


class Batch:
    """The documents of one group, in an order that does not depend on how the group arrived."""

    def __init__(self, rows: pa.Table):
        keys = [NO_KEY if k is None else k for k in rows.column("id").to_pylist()]
        texts = rows.column("data").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.given = [None if keys[i] == NO_KEY else keys[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.order = order

    def anchors(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``row, at, gram hash, surroundings' hash, left, right`` per chunk of bytes, places counted in the document."""
        pending: list[tuple[int, int, int, int, int]] = []
        total = 0
        for row, text in enumerate(self.texts):
            if len(text) < LENGTH:
                continue
            for core in range(0, len(text), CHUNK):
                until = min(len(text), core + CHUNK)
                pending.append((row, core, until, max(0, core - 2 * LENGTH), min(len(text), until + 2 * LENGTH)))
                total += until - core
                if total >= CHUNK:
                    yield self._of(pending)
                    pending, total = [], 0
        if pending:
            yield self._of(pending)

    def _of(self, pieces: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, ...]:
        row, core, until, low, high = np.array(pieces, np.int64).T
        text = np.frombuffer(b"".join(self.texts[p[0]][p[3] : p[4]] for p in pieces), np.uint8)
        ends = np.cumsum(high - low)
        at, grams, around, left, right = anchors(text, ends)
        of = np.searchsorted(ends, at, side="right")
        shift = low[of] - (ends[of] - (high - low)[of])
        keep = (at + shift >= core[of]) & (at + shift < until[of])
        of, shift = of[keep], shift[keep]
        return row[of], at[keep] + shift, grams[keep], around[keep], left[keep] + shift, right[keep] + shift


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane: high planes are alike and compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pieces(n: int, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers 0 to n - 1 grouped by ``order``: each value with where it stands."""
    by = np.argsort(order, kind="stable")
    cuts = np.flatnonzero(np.diff(order[by])) + 1
    for part in np.split(by, cuts) if n else []:
        yield int(order[part[0]]), part


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted table's keys change."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


_FOUND = "batch int, bucket int, grams binary, around binary, least binary"
_ANSWER = "batch int, kind int, a binary, b binary, c binary"
_AROUND = "bucket int, batch int, grams binary, rows binary, keys binary, at binary, sizes binary, data binary"
_FOUND_SCHEMA = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("around", pa.binary()), ("least", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_AROUND_SCHEMA = pa.schema([("bucket", pa.int32()), ("batch", pa.int32())] + [(n, pa.binary()) for n in "grams rows keys at sizes data".split()])


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _find(buckets: int):
    """Per batch: each pair of gram and surroundings once, with its smallest key, dealt to buckets of grams."""

    def run(rows: pa.Table) -> pa.Table:
        batch = Batch(rows)
        found = [(g, a, batch.keys[r]) for r, _, g, a, _, _ in batch.anchors()]
        out = []
        if found:
            all_grams, all_around, all_keys = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            number = rows.column("batch")[0].as_py()
            for bucket, part in _pieces(len(all_grams), _bucket(all_grams, buckets)):
                grams, around, keys = all_grams[part], all_around[part], all_keys[part]
                order = np.lexsort((keys, around, grams))
                grams, around, keys = grams[order], around[order], keys[order]
                first = _firsts(grams, around)
                last = np.r_[first[1:], len(keys)] - 1
                low, least = grams[first] & np.uint64((1 << 40) - 1), keys[first]
                around = around[first] | (keys[last] != least).astype(np.uint64)
                packed = low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype("u1").tobytes()
                out.append({"batch": number, "bucket": bucket, "grams": packed, "around": around.astype("<u8").tobytes(), "least": _planes(least)})
        return pa.Table.from_pylist(out, _FOUND_SCHEMA)

    return run


def _grams(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _answer(rows: pa.Table) -> pa.Table:
    """Per bucket: to each batch, its surroundings that others share, with their smallest key, and grams with several surroundings.

    Only the smallest key over all batches matters, so a string in very many documents counts once per batch.
    """
    rows = rows.sort_by("batch")
    grams = np.concatenate([_grams(b) for b in rows.column("grams").to_pylist()])
    around = np.concatenate([np.frombuffer(b, "<u8") for b in rows.column("around").to_pylist()])
    least = np.concatenate([_unplanes(b) for b in rows.column("least").to_pylist()])
    sizes = [len(b) // 5 for b in rows.column("grams").to_pylist()]
    several, around = around & np.uint64(1), around & ~np.uint64(1)
    order = np.lexsort((least, around, grams))
    g, a, k = grams[order], around[order], least[order]
    pair = _firsts(g, a)
    smallest = np.repeat(k[pair], np.diff(np.r_[pair, len(k)]))
    gram = _firsts(g)
    runs = np.diff(np.r_[gram, len(g)])
    varied = np.repeat(np.minimum.reduceat(smallest, gram) != np.maximum.reduceat(smallest, gram), runs)
    wanted = (several[order] > 0) | (k > smallest) | varied
    of = np.repeat(np.arange(len(sizes)), sizes)[order][wanted]
    a, smallest, varied = a[wanted], smallest[wanted], varied[wanted]
    batches = rows.column("batch").to_pylist()
    out = [
        {"batch": batches[n], "kind": 0, "a": a[part].astype("<u8").tobytes(), "b": _planes(smallest[part]), "c": varied[part].tobytes()}
        for n, part in _pieces(len(of), of)
    ]
    return pa.Table.from_pylist(out, _ANSWER_SCHEMA)


def _matched(batch: Batch, answers: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a batch that an answer speaks of, with ``known``: the smallest key, and ``varied``."""
    own = [r for r in answers.to_pylist() if r["kind"] == 0]
    if not own:
        return
    around = np.concatenate([np.frombuffer(r["a"], "<u8") for r in own])
    least = np.concatenate([_unplanes(r["b"]) for r in own])
    varied = np.concatenate([np.frombuffer(r["c"], bool) for r in own])
    order = np.argsort(around)
    around, least, varied = around[order], least[order], varied[order]
    for row, at, grams, a, left, right in batch.anchors():
        place = np.minimum(np.searchsorted(around, a), len(around) - 1)
        hit = np.flatnonzero(around[place] == a)
        place = place[hit]
        yield row[hit], at[hit], grams[hit], left[hit], right[hit], least[place], varied[place]


def _surround(buckets: int):
    """Per batch: the bytes around anchors that occur with other surroundings elsewhere, from their smallest documents."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and answers.num_rows:
            batch, number = Batch(rows), rows.column("batch")[0].as_py()
            kept = []
            for row, _, grams, left, right, least, varied in _matched(batch, answers):
                held = np.flatnonzero(varied & (batch.keys[row] == least))
                kept.append((row[held], grams[held], left[held], right[held]))
            row, grams, left, right = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * 4
            for bucket, part in _pieces(len(row), _bucket(grams, buckets) if len(row) else row):
                data = b"".join(batch.texts[r][a:b] for r, a, b in zip(row[part].tolist(), left[part].tolist(), right[part].tolist(), strict=True))
                out.append(
                    {
                        "bucket": bucket, "batch": number, "grams": grams[part].astype("<u8").tobytes(), "rows": row[part].astype("<i4").tobytes(),
                        "keys": _planes(batch.keys[row[part]]), "at": _planes(left[part]), "sizes": (right - left)[part].astype("u1").tobytes(), "data": data,
                    }
                )
        return pa.Table.from_pylist(out, _AROUND_SCHEMA)

    return run


def classes_of(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text, sorted, and for each whether its ``length`` bytes differ from those of the place before.

    Places are sorted by their next bytes, which gives the Burrows-Wheeler transform. Breadth-first, intervals
    of places that begin with equal strings are extended backward by one byte: a byte that precedes some places of an
    interval leads to the interval of the longer string. Where an interval ends, the common prefix with the next place is
    as long as the string was before the step, unless a shorter one is known; only such intervals go on. Common
    prefixes come out by increasing length, and the search stops at ``length``: what has no boundary then is equal.
    The text counts as a ring; callers leave out places whose bytes run over a piece's end.
    """
    n = len(text)
    place = _sorted_places(text, length)
    before = text[place - 1]
    by_byte = np.argsort(before, kind="stable")
    leads = np.empty(n, np.int64)  # where the place one to the left stands
    leads[by_byte] = np.arange(n)
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        sizes = high - low
        if not len(sizes):
            break
        if len(sizes) == 1:
            rows, of = np.arange(low[0], high[0]), np.zeros(sizes[0], np.int64)
        else:
            of = np.repeat(np.arange(len(sizes)), sizes)
            rows = np.arange(len(of)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        byte = before[rows]
        order = np.argsort(byte, kind="stable")
        byte, of, rows = byte[order], of[order], rows[order]
        first = _firsts(byte, of)
        begin = leads[rows[first]]
        end = begin + np.diff(np.r_[first, len(rows)])
        new = ~boundary[end]
        low, high = begin[new], end[new]
        boundary[high] = True
    return place, boundary[:-1]


def _sorted_places(text: np.ndarray, length: int) -> np.ndarray:
    """Places of a ring sorted by ``length`` bytes at least, by doubling."""
    n = len(text)
    ring = np.concatenate([text, text[:8] if n >= 8 else np.resize(text, 8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | ring[i : i + n]
    known = 8
    while True:
        order = np.argsort(rank, kind="stable")
        if known >= length:
            return order
        ordered = rank[order]
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        if dense[order[-1]] == n - 1:
            return order
        rank = dense * np.uint64(n) + np.roll(dense, -known)
        known *= 2


def _compare(rows: pa.Table) -> pa.Table:
    """Per bucket: the strings in gathered surroundings that also lie in a document with a smaller key, to each batch."""
    found = []
    table = rows.to_pylist()
    grams = np.concatenate([np.frombuffer(r["grams"], "<u8") for r in table])
    number = np.concatenate([np.full(len(r["grams"]) // 8, r["batch"], np.int64) for r in table])
    row = np.concatenate([np.frombuffer(r["rows"], "<i4") for r in table]).astype(np.int64)
    keys = np.concatenate([_unplanes(r["keys"]) for r in table])
    at = np.concatenate([_unplanes(r["at"]) for r in table])
    sizes = np.concatenate([np.frombuffer(r["sizes"], "u1") for r in table]).astype(np.int64)
    data = np.frombuffer(b"".join(r["data"] for r in table), np.uint8)
    starts = np.cumsum(sizes) - sizes
    del table
    order = np.argsort(grams, kind="stable")
    after = np.r_[_firsts(grams[order])[1:], len(order)]
    chunk = np.cumsum(sizes[order])[after - 1] // CHUNK
    cuts = [0, *after[np.r_[chunk[1:] != chunk[:-1], True]].tolist()]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = order[a:b]
        size = sizes[part]
        begin = np.cumsum(size) - size
        text = data[np.repeat(starts[part] - begin, size) + np.arange(size.sum())]
        place, new = classes_of(text)
        of = np.searchsorted(begin, place, side="right") - 1
        inside = place + LENGTH <= begin[of] + size[of]
        kind = (np.cumsum(new) - 1)[inside]
        of, place = of[inside], place[inside]
        if not len(of):
            continue
        key = keys[part][of]
        smallest = np.full(kind[-1] + 1, NO_KEY)
        np.minimum.at(smallest, kind, key)
        repeat = key > smallest[kind]
        of, place = of[repeat], place[repeat]
        found.append((number[part][of], row[part][of], at[part][of] + place - begin[of]))
    out = []
    if found:
        number, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
        for batch, part in _pieces(len(number), number):
            r, s = row[part], start[part]
            by = np.lexsort((s, r))
            r, s = r[by], s[by]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + LENGTH)])
            end = s[np.r_[first[1:], len(s)] - 1] + LENGTH
            out.append({"batch": batch, "kind": 1, "a": _planes(r[first]), "b": _planes(s[first]), "c": _planes(end)})
    return pa.Table.from_pylist(out, _ANSWER_SCHEMA)


_RESULT = [("id", LongType()), ("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType())]


def _whole_characters(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs made smaller until they begin and end between UTF-8 characters; none is left empty."""
    begin, end = begin.copy(), end.copy()
    inside = lambda at: np.array([0 <= x < len(text) and text[x] & 0xC0 == 0x80 for x in at.tolist()], bool)
    while (move := inside(begin)).any():
        begin[move] += 1
    while (move := inside(end)).any():
        end[move] -= 1
    return begin[begin < end], end[begin < end]


def _remove(form: str, rest: bool):
    """Per batch: what is left of each document, as ``bytes``, ``text`` or ``sha256``."""
    names = [n for n, _ in _RESULT] + ["rest"] * rest

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows)
        spans = [(row[late], left[late], right[late]) for row, _, _, left, right, least, _ in _matched(batch, answers) if len(late := np.flatnonzero(batch.keys[row] > least))]
        spans += [tuple(_unplanes(r[c]) for c in "abc") for r in answers.to_pylist() if r["kind"] == 1]
        of, low, high = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((low, of))
        of, low, high = of[order], low[order], high[order]
        cuts = np.searchsorted(of, np.arange(len(batch.texts) + 1))
        out: list[list] = [[], [], [], []]
        left_over = []
        for i, text in enumerate(batch.texts):
            size, removed, runs = len(text), 0, 0
            if cuts[i + 1] > cuts[i]:
                a, b = low[cuts[i] : cuts[i + 1]], np.maximum.accumulate(high[cuts[i] : cuts[i + 1]])
                first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                begin, end = a[first], b[np.r_[first[1:], len(b)] - 1]
                if form == "text":
                    begin, end = _whole_characters(text, begin, end)
                removed, runs = int((end - begin).sum()), len(begin)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (batch.given[i], size, removed, runs), strict=True):
                column.append(value)
            left_over.append(hashlib.sha256(text).digest() if form == "sha256" else text)
        kept = pa.array(left_over, pa.binary())
        columns = [*(pa.array(c, pa.int64()) for c in out), kept]
        if rest:
            columns.append(rows.column("rest").take(pa.array(batch.order, pa.int64())))
        return pa.table(columns, names=names)

    return run


def remove_repeats(
    rows: DataFrame, key: str = "doc_id", text: str = "text", form: str = "bytes", carry: Sequence[str] = ()
) -> DataFrame:
    """Each document without the strings of 50 bytes that also start in a document with a smaller key.

    Returns ``key, n_bytes, n_removed, n_spans`` and ``kept``: the remaining UTF-8 ``bytes``, where a cut can fall inside a
    character; their ``sha256``; or the remaining ``text``, for which runs end at whole characters. Columns named in
    ``carry`` follow as the struct ``rest``. Strings overlap, are judged on the input and don't cross documents.

    Documents form batches by a hash of the key. Every string of 50 bytes holds an anchor, the 20 bytes in it with the smallest
    hash; batches tell buckets each anchor with a hash of its surroundings once, and learn the smallest key that has these
    surroundings. Documents with larger keys lose them whole. Where an anchor has several surroundings, the
    smallest document of each sends the bytes, and the strings in them are compared exactly on a Burrows-Wheeler
    transform (``classes_of``). Text moves once; a string in very many documents costs one row per batch.
    Surroundings count as equal by 103 bits of hash.

    The key is a whole number. A null key is larger than all others and not smaller than another null. A null text is empty.
    Texts under 50 bytes are left as they are, and rows with one key don't shorten each other. Documents longer than
    ``CHUNK`` are worked on in parts. Further columns are not looked at. An empty table gives an empty result.
    """
    if form not in ("bytes", "text", "sha256"):
        raise ValueError(f"no form {form}")
    pick(rows, id=key, text=text)
    rest = [F.struct(*[named(c) for c in carry]).alias("rest")] if carry else []
    base = rows.select(
        named(key).cast("long").alias("id"), F.coalesce(named(text), F.lit("")).cast("binary").alias("data"), *rest
    )
    total = base.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    batches, buckets = int(total // BATCH_BYTES) + 1, int(total // BUCKET_BYTES) + 1
    spread = F.coalesce(F.xxhash64("id"), F.lit(0))
    filed = base.withColumn("batch", F.pmod(spread, F.lit(batches)).cast("int")).select("batch", *base.columns)
    found = filed.groupBy("batch").applyInArrow(_freed(_find(buckets)), _FOUND)
    answers = found.groupBy("bucket").applyInArrow(_freed(_answer), _ANSWER)
    around = filed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_freed(_surround(buckets)), _AROUND)
    marks = around.groupBy("bucket").applyInArrow(_freed(_compare), _ANSWER)
    told = answers.union(marks)
    result = StructType([StructField(n, t) for n, t in _RESULT] + [f for f in base.schema if f.name == "rest"])
    out = filed.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_freed(_remove(form, bool(carry))), result)
    return out.withColumn("kept", F.decode("kept", "UTF-8") if form == "text" else F.col("kept")).withColumnRenamed("id", key)
