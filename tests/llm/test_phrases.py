"""Frequent phrases and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=5):
    found, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[lang, n, " ".join(words[i : i + n])] += 1
    return found, totals


def plain_collocations(rows, least, top, covered=100, longest=5):
    found, totals = plain_counts(rows, longest)
    many = {k: a for k, a in found.items() if a >= least}
    out = []
    for (lang, n, phrase), a in many.items():
        if n == 1:
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, n):
            left, right = many[lang, k, " ".join(w[:k])], many[lang, n - k, " ".join(w[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(
            o == lang and m > n and 100 * b >= covered * a and f" {phrase} " in f" {other} " for (o, m, other), b in many.items()
        )
        if not inside:
            out.append((lang, phrase, a, left, right, totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.fixture
def texts():
    rng = random.Random(4)
    words = ["Abel", "bo", "ça", "dum-dum", "é", "f\x01g", "ÀB", "z z", "h", "ii"]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "!", "\r\n"]
    make = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 120)))
    rows = [(i, make(), rng.choice(["en", "en", "fr", None]), "a") for i in range(90)]
    return [*rows, (90, None, "en", "a"), (91, "", "de", "a"), (92, " .,\n", None, None), (5, rows[5][1], "en", "a"), (None, "Abel bo ça", "en", "a")]


def seen(df):
    return sorted((r["lang"], r["n"], r["phrase"], r["count"]) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 9, 3])
def test_counts_do_not_depend_on_fingerprints(docs, texts, bits):
    found, words = phrases.frequent_phrases(docs(texts).repartition(3), least=12, bits=bits)
    plain, totals = plain_counts(texts)
    assert seen(found) == sorted((*k, a) for k, a in plain.items() if a >= 12)
    assert {r["lang"]: r["words"] for r in words.collect()} == {k: n for k, n in totals.items() if n}


@pytest.mark.parametrize("covered", [100, 60])
def test_collocations(docs, texts, covered):
    out = phrases.collocations(docs(texts), least=8, top=40, covered=covered).drop("seen_doc", "seen_byte")
    assert sorted(map(tuple, out.collect())) == plain_collocations(texts, 8, 40, covered)


def test_files_in_many_splits(spark, docs, texts, tmp_path):
    docs(texts * 3).repartition(7).write.parquet(str(tmp_path / "t"))
    found, _ = phrases.frequent_phrases(spark.read.parquet(str(tmp_path / "t")), least=20)
    assert seen(found) == sorted((*k, 3 * a) for k, a in plain_counts(texts)[0].items() if 3 * a >= 20)


def test_pointers_lead_to_the_phrase(docs, texts):
    rows = [r for i, r in enumerate(texts) if r[0] is not None and i < 90]
    found, _ = phrases.frequent_phrases(docs(rows), least=10)
    by_id = {r[0]: (r[1], r[2]) for r in rows}
    for r in found.collect():
        text, lang = by_id[r["seen_doc"]]
        rest = text.encode()[r["seen_byte"] :].decode().translate(LOWER)
        assert " ".join(re.findall("[^ \t]+", rest)).startswith(r["phrase"].split(" ")[0]) and r["lang"] == (lang or "und")


def test_large_counts_are_exact(docs):
    rows = [(i, "a b " * 400, "en", "a") for i in range(40)]
    out = phrases.collocations(docs(rows), least=100, top=10)
    assert sorted(map(tuple, out.drop("seen_doc", "seen_byte").collect())) == plain_collocations(rows, 100, 10)


def test_empty_tables(docs):
    assert phrases.collocations(docs([])).count() == 0
    assert phrases.collocations(docs([(1, None), (2, ""), (3, "once only")])).count() == 0


def test_long_pieces_are_cut_nowhere(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 64)
    texts = ["ab " * 100, "x. y " + "cd " * 50 + ". e", "", "f" * 300, "g h"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.encode() for t in texts], pa.binary()), "salt": pa.array([1, 1, 2, 2, 1])}).slice(0)
    with np.errstate(over="ignore"):
        parts = list(phrases.slices(batch, [phrases.Powers()]))
    words = [w.phrase(i, 1).decode() for w, _, _ in parts for i in range(len(w.start))]
    assert words == [w for t in texts for w in re.findall(r"[^ .]+", t)]
    assert sum(int(w.whole(2).sum()) for w, _, _ in parts) == 99 + 0 + 50 + 0 + 1


def test_memory_of_a_counting_task():
    import tracemalloc

    rng = np.random.default_rng(5)
    text = "\n".join(" ".join(f"w{i}" for i in rng.integers(0, 1 << 30, 1000)) for _ in range(2500)).encode()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.binary()), "salt": pa.array([1]), "split": pa.array([7])})
    tracemalloc.start()
    rows = sum(b.num_rows for b in phrases._counted(2, None, (1 << 64) - 1)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 2_497_000 < rows <= 2500 * 999 and most < 260e6, most
