import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import repeats
from gridweave.llm.repeats import LENGTH, classes_of, remove_repeats


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "größe", "été", "a", "word", "x" * 9, "\0"])
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(30))) for _ in range(3)]
        parts.insert(1, r.choice(passages) if r.random() < 0.6 else "")
        rows.append((i * 3 - 7, "|".join(parts)))
    rows += [(1000, rows[0][1]), (-50, rows[1][1]), (1001, "a" * 700), (1002, "a" * 60), (1003, "ab" * 300), (1004, None), (1005, ""), (1006, "short"), (1000, rows[0][1])]
    return rows


@pytest.mark.parametrize("chunk", [300, 1 << 21])
def test_against_brute_force(docs, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = texts(3, 60)
    got = remove_repeats(docs(rows).repartition(3), carry=["source", "key"])
    found = got.collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == brute(rows)
    assert {r.rest.key for r in found} == {"x"}
    hashes = remove_repeats(docs(rows), form="sha256").collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in hashes) == sorted((r.doc_id, hashlib.sha256(bytes(r.kept)).digest()) for r in found)


def test_text_form_keeps_characters(docs):
    a, b = "é" * 40, "xé" + "é" * 30 + "x"
    rows = remove_repeats(docs([(0, a), (1, b), (2, "y" + a)]), form="text").collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[0] == a and kept[2] == "y" and "�" not in kept[1]


def test_null_keys_and_empty_table(docs):
    text = "abcdefghij" * 12
    rows = remove_repeats(docs([(None, text), (4, text), (None, text)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (True, 120), (True, 120)]
    assert remove_repeats(docs([])).count() == 0


def test_interval_expansion():
    r = np.random.default_rng(5)
    for n, letters in ((1, 1), (60, 1), (400, 2), (3000, 3)):
        text = r.integers(97, 97 + letters, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        place, new = classes_of(text)
        ring = bytes(text) * (2 + LENGTH // n)
        strings = [ring[p : p + LENGTH] for p in place]
        assert strings == sorted(strings)
        assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(n)]


def test_memory_of_a_task():
    """Beside its batch a task holds little: a part of the text at a time, and the anchors of one bucket."""
    drawn = np.random.default_rng(9)
    phrase = drawn.integers(97, 123, 30).astype(np.uint8).tobytes()
    texts = [drawn.integers(97, 123, 4000).astype(np.uint8).tobytes() + phrase for _ in range(2000)]
    rows = pa.table({"batch": pa.array([3] * len(texts), pa.int32()), "id": list(range(len(texts))), "data": texts})

    def measured(work, *tables):
        tracemalloc.start()
        try:
            return repeats._freed(work)(*tables), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    found, finding = measured(repeats._find(20), rows)
    answers = pa.concat_tables(repeats._answer(found.filter(pa.array([b == n for b in found["bucket"].to_pylist()]))) for n in range(20))
    around, gathering = measured(repeats._surround(20), rows, answers)
    left, removing = measured(repeats._remove("text", False), rows, answers)
    assert max(finding, gathering, removing) < 62, (finding, gathering, removing)
    # A batch is one row to a bucket, however many parts its text has.
    assert 0 < around.num_rows == len(set(around["bucket"].to_pylist()))
    assert left.num_rows == len(texts)
