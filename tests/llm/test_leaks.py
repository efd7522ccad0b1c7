"""Shared passages against looking at every window."""

import random
import re

import pytest

from gridweave.llm import leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window):
    out = []
    for doc_id, text, *_ in docs:
        own, hit, named = words(text), set(), set()
        for name, item in items:
            w = words(item)
            size = min(window, len(w))
            wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(own) - size + 1) if size else []:
                if tuple(own[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    named.add(name)
        out.append((doc_id, len(own), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=repr)


@pytest.fixture
def tables(spark, docs):
    rng = random.Random(9)
    vocabulary = ["Uno", "due", "É", "4", "cinq", "six-six", "aé"]
    some = lambda low, high: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(low, high)))
    items = [(i, some(1, 14)) for i in range(30)]
    items += [(30, None), (31, ""), (32, "??"), (None, some(6, 9)), (3, items[3][1]), (33, items[4][1]), (34, some(60, 90))]
    rows = [(i, some(0, 60)) for i in range(60)] + [(60, None), (61, ""), (62, "?!"), (7, "due Uno"), (None, items[0][1])]
    rows += [(63, "x " + items[-1][1] + " y"), (64, items[5][1].upper())]
    rows.append(rows[3])
    return rows, items, docs(rows).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [1, 3, 6, 10])
def test_every_window(tables, window):
    rows, items, documents, tests = tables
    assert found(leaks.find_leaks(documents, tests, window=window)) == plain(rows, items, window)


def test_several_automata(tables, monkeypatch):
    rows, items, documents, tests = tables
    monkeypatch.setattr(leaks, "BLOCK", 120)
    assert leaks.automata(tests, window=6)[1] > 1
    out = leaks.find_leaks(documents, tests, window=6)
    assert found(out) == plain(rows, items, 6)
    for r in out.collect():
        ends = [(s["first"], s["last"]) for s in r["spans"]]
        assert all(b + 1 < c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))


def test_parts_of_a_long_item(tables, monkeypatch):
    rows, items, documents, tests = tables
    monkeypatch.setattr(leaks, "PIECE", 16)
    batches = leaks._item_parts(6)
    parts = leaks.pa.Table.from_batches(list(batches([leaks.pa.RecordBatch.from_pydict({"item": ["a"], "text": [items[-1][1].encode()]})])))
    texts = [words(p.decode()) for p in parts.column("words").to_pylist()]
    whole = words(items[-1][1])
    windows = lambda w: {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
    assert len(texts) > 3 and set().union(*map(windows, texts)) == windows(whole)


def test_chunks_cut_no_word(monkeypatch):
    text = ("ab " * 20 + "é" * 50 + " x" * 9).encode()
    whole = list(leaks.words_of(text))
    monkeypatch.setattr(leaks, "CHUNK", 7)
    assert list(leaks.words_of(text)) == whole


def test_texts_without_leaks(docs, spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {item.title()}! After it, and more words than that to keep the share low enough."), (2, item), (3, "Nothing here."), (4, None)]
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs(rows), tests).collect()}
    assert left == {1: "Before, ! After it, and more words than that to keep the share low enough.", 3: "Nothing here.", 4: None}
    kept = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs(rows), tests, most_words=20, most_share=1.0).collect()}
    assert kept == dict((r[0], r[1]) for r in rows)


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(leaks.find_leaks(docs([(1, "a b")]), none)) == [(1, 2, 0, [])]
    assert leaks.find_leaks(docs([]), none).count() == 0
