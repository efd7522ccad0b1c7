"""Packing token sequences: concatenate and cut."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

SLICE = 256  # texts encoded at once
MOST_BROADCAST = 1_000_000  # partitions whose first places are broadcast, 24 bytes each
#: Characters for which the two tokeniser libraries surely split words alike.
_PLAIN = re.compile("[^\\x20-\\x7e\\n\\tÀ-ɏ]")


class Encoder:
    """Ids of texts by a tokenizers file; by the equal ranks in tiktoken where that is known to agree.

    The second library is about three times as fast. A text with characters outside ASCII and Latin letters goes to the first,
    as does one that holds the name of a special token, which stands for that token's id.
    """

    def __init__(self, json_file: str, ranks_file: str | None = None, pattern: str | None = None, special: Sequence[str] = ()):
        self._file, self._slow, self._fast = json_file, None, None
        if ranks_file:
            self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
            import base64

            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self._fast and (text.isascii() or not _PLAIN.search(text)) and not self._special.search(text):
            return self._fast.encode_ordinary(text)
        if not self._slow:  # most tasks never need it, and it holds its vocabulary a second time
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._file)
        return self._slow.encode(text, add_special_tokens=False).ids


def public_encoder() -> dict[str, str | list[str]]:
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = [token["content"] for token in json.load(f).get("added_tokens", [])]
    return {
        "special": special,
        "json_file": public.path("byte_bpe_50k.json"),
        "ranks_file": public.path("byte_bpe_50k.tiktoken"),
        "pattern": public.PATTERN,
    }


def _tokenised(encoder: dict, end_id: int):
    schema = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(**encoder)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                ids = [np.array([*encode(t or ""), end_id], "<u4") for t in piece.column("text").to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("key").cast(pa.int64()),
                        pa.array(np.full(len(n), part, np.int64)),
                        pa.array(starts),
                        pa.array(n),
                        pa.array([_narrow(x) for x in ids], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; told apart by the length."""
    return (ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()


def _cut(length: int):
    schema = pa.schema(
        [("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out: list[list] = [[] for _ in schema]
                for row in batch.slice(at, SLICE).to_pylist():
                    n, first = row["n"], row["first"]
                    ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * n else "<u4").astype("<u4")
                    begin = 0
                    while begin < n:
                        sequence, offset = divmod(first + begin, length)
                        size = min(length - offset, n - begin)
                        whole = min(length, row["total"] - sequence * length)
                        padded = whole if whole.bit_count() == 1 else length
                        piece = [row["key"], begin, size, ids[begin : begin + size].tobytes(), n, sequence, offset, padded]
                        for column, value in zip(out, piece, strict=True):
                            column.append(value)
                        begin += size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def pack(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    end_id: int = 1,
    encoder: dict | None = None,
) -> DataFrame:
    """Pieces of documents, laid end to end and cut into sequences of ``length`` ids.

    Returns ``key, start, length, ids, doc_tokens, sequence_id, offset`` and ``padded_length``. ``ids`` is binary,
    four bytes an id, little-endian. A document is its text's ids and ``end_id``. Only the last sequence can be
    short; it is padded to ``length`` unless its own length is a power of two.

    Pass one encodes each text once, numbers the ids within its partition and stores them in the shared folder.
    Totals per partition, a row each, give every partition's first place by a prefix sum. Pass two adds it
    and cuts at fixed places; a document that crosses a boundary gives a piece on either side. First places are broadcast up to
    ``MOST_BROADCAST`` partitions and joined beyond; no text is shuffled, and no key can be hot, and a document of any length takes one row and one pass over its ids.

    The key must be a whole number or null and is passed on. A null text is empty: one piece with ``end_id``.
    The name of a special token in a text is that token, as the tokeniser has it. Repeated rows are packed one by one. Further columns are not looked at. An empty table gives no pieces.
    """
    schema = "key long, part long, start long, n long, ids binary"
    run = _tokenised(encoder or public_encoder(), end_id)
    tokens = stored(pick(rows, key=key, text=text).mapInArrow(run, schema), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    small = totals.count() <= MOST_BROADCAST
    placed = tokens.join(F.broadcast(firsts) if small else firsts, "part")
    pieces = placed.select("key", "n", "ids", (F.col("before") + F.col("start")).alias("first"), "total").mapInArrow(
        _cut(length),
        "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long",
    )
    return pieces.withColumnRenamed("key", key)


def unpack(pieces: DataFrame) -> DataFrame:
    """Whole sequences from pieces: ``sequence_id, ids`` (array of ints, without padding)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.transform("parts", lambda p: p["ids"]).alias("ids"))
