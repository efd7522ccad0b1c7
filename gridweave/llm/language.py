"""Language identification: the family first, then support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_memory, named, pick

UNKNOWN = "und"
BITS = 13  # of the feature hash
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 600  # documents of a language that the model is fitted on at most
LANGUAGES = 128  # that the model is fitted on at most, those with the most documents
SLICE = 256

# Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa sd si ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def family_of(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), language)


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter n-grams, over bytes of the lower-case text; None if no letter is there."""
    if not text or not _LETTER.search(text):
        return None
    letters = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), np.uint8)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters = letters[keep].astype(np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(letters), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(letters) - n + 1] * np.uint32(0x01000193) + letters[n - 1 :] + np.uint32(n)
        if not len(h):
            break
        if n in GRAMS:
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a vector of length 1, whatever the length of the text."""
    return np.sqrt(counts / max(1, counts.sum()))


def _fit(all_x: np.ndarray, rows: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Linear support vector machine over the numbered rows, with squared hinge loss; the last weight is the bias.

    The rows are copied once, and what is made of them on the way is made of ``SLICE`` at a time.
    """
    x = np.empty((len(rows), all_x.shape[1] + 1), np.float32)
    norms = np.empty(len(rows), np.float32)
    for at in range(0, len(rows), SLICE):
        piece = x[at : at + SLICE]
        piece[:, :-1], piece[:, -1] = all_x[rows[at : at + SLICE]], 1
        piece *= 4
        norms[at : at + SLICE] = (piece * piece).sum(1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * float((share * norms).sum()) + penalty)
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (penalty * z - 2 * (x.T @ (share * y * slack)))
        z = new + t / (t + 3) * (new - w)
        w = new
    return (w * 4).astype(np.float32)


@dataclass
class Model:
    """Machines between families and, in each family, between its languages, as columns of one matrix."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    @classmethod
    def fit(cls, languages: Sequence[str], x: np.ndarray) -> Model:
        labels = np.array(languages, object)
        families: dict[str, list[str]] = {}
        for language in sorted(set(languages)):
            families.setdefault(family_of(language), []).append(language)
        of = np.array([family_of(v) for v in languages], object)
        jobs = [((a, b), of) for a, b in combinations(sorted(families), 2)]
        jobs += [(pair, labels) for members in families.values() for pair in combinations(members, 2)]
        columns = []
        for (a, b), kind in jobs:
            rows = np.flatnonzero((kind == a) | (kind == b))
            columns.append(_fit(x, rows, np.where(kind[rows] == a, 1, -1).astype(np.float32)))
        weights = np.stack(columns, 1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32)
        return cls(families, [pair for pair, _ in jobs], weights)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        margins = _scaled(counts) @ self.weights[:-1] + self.weights[-1]
        between = dict(zip(self.pairs, margins.tolist(), strict=True))
        family, sure = _winner(sorted(self.families), between)
        language, surer = _winner(self.families[family], between)
        return language, sure * surer


def _winner(names: list[str], between: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The name with most duels won, then the largest margins; and how sure its closest duel is."""
    if len(names) == 1:
        return names[0], 1.0
    duels = {n: [] for n in names}
    for a, b in combinations(names, 2):
        duels[a].append(between[a, b])
        duels[b].append(-between[a, b])
    best = max(names, key=lambda n: (sum(m > 0 for m in duels[n]), sum(duels[n]), n))
    return best, float(1 / (1 + np.exp(-4 * min(duels[best]))))


def held_out(key: Column) -> Column:
    """Whether CRC-32 of the key's text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    rows: DataFrame, key: str, text: str, language: str, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES
) -> Model | None:
    """A model from at most ``per_language`` labelled documents of each of the ``languages`` most frequent labels, chosen by a hash of the key.

    A row per chosen label is broadcast, so documents are drawn where they are read and only the drawn ones are shuffled.

    Rows with a held-out or null key or without a label don't count. The driver gets sparse counts of the chosen texts only.
    None if nothing can be learned from.
    """
    known = pick(rows, key=key, language=language).where("language IS NOT NULL AND key IS NOT NULL")
    known = known.where(~held_out(F.col("key"))).withColumn("draw", F.xxhash64(F.col("key"), F.lit("language")))
    counts = known.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(languages)
    share = F.shiftrightunsigned("draw", 1) / float(1 << 63)
    likely = known.join(F.broadcast(counts), "language").where(share * F.col("n") < 2 * per_language + 50)
    chosen = likely.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("draw", "key")))
    chosen = chosen.where(F.col("r") <= per_language).select("key", F.col("language").alias("label")).distinct()
    texts = pick(rows, key=key, text=text, language=language).join(chosen, "key").where("language = label")
    texts = texts.groupBy("label", "key").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (c := features(row["text"])) is not None:
                    slots = np.flatnonzero(c)
                    out.append({"label": row["label"], "slots": slots.tolist(), "counts": c[slots].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("label", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))

    found = texts.select("label", "text").mapInArrow(counted, "label string, slots array<int>, counts array<long>").toArrow()
    if not found.num_rows:
        return None
    x = np.zeros((found.num_rows, 1 << BITS), np.float32)
    at = 0
    for batch in found.to_batches():
        for slots, n in zip(batch.column("slots"), batch.column("counts"), strict=True):
            values = n.values.to_numpy()
            x[at, slots.values.to_numpy()] = np.sqrt(values / values.sum())
            at += 1
    labels = found.column("label").to_pylist()
    del found, batch, slots, n, values
    model = Model.fit(labels, x)
    del x
    free_memory()  # the driver goes on with other work
    return model


def identify(
    rows: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", model: Model | None = None,
    per_language: int = PER_LANGUAGE, carry: bool = False,
) -> DataFrame:
    """The language of each whole text: ``key, held_out, lang_pred, score``.

    Without a model, one is fitted on the rows that aren't held out (see ``fit``). Predictions see the text alone.
    The machines between families choose one, those within it a language; each is linear over hashed letter
    n-grams. ``score`` is the product of how sure the closest duels of both levels are. A null text or one
    without a letter is ``und`` with score 0, as is any text if there is nothing to learn from. With one
    language known, all texts are of it. The size of the model depends on the languages only. Each row
    is judged alone: repeated rows, null keys and further columns change nothing. ``carry`` adds ``row``, the whole
    input row, so that rows can be chosen without a join.
    """
    model = model or fit(rows, key, text, language, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                found = []
                for t in piece.column("text").to_pylist():
                    counts = features(t) if model else None
                    found.append((UNKNOWN, 0.0) if counts is None else model.predict(counts))
                columns = [piece.column("key"), piece.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                names = ["key", "held_out", "lang_pred", "score"]
                if carry:
                    columns, names = [*columns, piece.column("row")], [*names, "row"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    pick(rows, key=key, text=text)
    whole = [F.struct(*[named(c) for c in rows.columns]).alias("row")] if carry else []
    one = rows.select(named(key).alias("key"), held_out(named(key)).alias("held_out"), named(text).alias("text"), *whole)
    schema = StructType([one.schema["key"], one.schema["held_out"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    schema = StructType([*schema, one.schema["row"]]) if carry else schema
    return one.mapInArrow(run, schema).withColumnRenamed("key", key)
