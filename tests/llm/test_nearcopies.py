import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.llm import nearcopies
from gridweave.llm.components import components
from gridweave.llm.nearcopies import align, distances, near_copies


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distances():
    r = random.Random(2)
    pairs = []
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randrange(40))]
        b = [x for x in a if r.random() > 0.1] + [r.randrange(6) for _ in range(r.randrange(4))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    true = [levenshtein(a.tolist(), b.tolist()) for a, b in pairs]
    for band in (0, 3, 12):
        got = distances(pairs, band)
        assert all(g == t if t <= band else g > band for g, t in zip(got, true, strict=True))
    gaps = align(pairs)
    for g, t, (a, b) in zip(gaps, true, pairs, strict=True):
        share = t / max(len(a), len(b), 1)
        assert share - 1e-9 <= g <= 0.2 if share <= 0.2 else g > 0.2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, None)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_classes_against_all_pairs(docs, monkeypatch):
    r = random.Random(7)
    texts = {}
    for g in range(12):
        base = words(r, 150)
        for _ in range(5):
            copy = [x if r.random() > 0.02 * (g % 4) else f"e{r.randrange(9999)}" for x in base]
            texts[len(texts)] = " ".join(copy)
    passage = " ".join(words(r, 40))
    for _ in range(30):
        texts[len(texts)] = passage + " " + " ".join(words(r, 20))
    texts |= {200: texts[3], 201: texts[3], 202: "one", 203: "one two", 204: "one", 205: None, 206: "  ", 207: "  "}
    rows = [*texts.items(), (None, texts[0]), (3, texts[3])]
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    got = near_copies(docs(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    parent = {k: k for k in texts}
    find = lambda x: x if parent[x] == x else find(parent[x])
    split = {k: (t or "").split() for k, t in texts.items()}
    near = 0
    for a in texts:
        for b in texts:
            if a < b and split[a] and split[b] and min(len(split[a]), len(split[b])) >= 0.8 * max(len(split[a]), len(split[b])):
                if len(set(split[a]) & set(split[b])) >= 0.5 * len(set(split[a])) and levenshtein(split[a], split[b]) <= 0.2 * max(len(split[a]), len(split[b])):
                    near += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert near > 50 and {k: of[k] for k in texts} == {k: find(k) for k in texts}
    assert all(r.kept == (r.class_id == r.doc_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert next(r.class_size for r in got if r.doc_id == 202) == 2


def test_odd_tables(docs):
    assert near_copies(docs([])).count() == 0
    one = near_copies(docs([(4, "a b c d e f g")])).collect()
    assert [(r.doc_id, r.class_id, r.class_size, r.kept) for r in one] == [(4, 4, 1, True)]


def test_fringe_of_a_large_class(spark, docs, monkeypatch):
    r = random.Random(11)
    change = lambda text, share: [x if r.random() > share else f"e{r.randrange(10**6)}" for x in text]
    base = words(r, 150)
    copies = [change(base, 0.06) for _ in range(2000)]
    fringe = [change(copies[i], 0.1) for i in range(300)]
    rows = docs([" ".join(t) for t in copies + fringe])
    counted, verified = [], nearcopies._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_verified", counting)
    of = {r.doc_id: r.class_id for r in near_copies(rows).collect()}
    pairs = sum(counted)
    assert pairs < 40 * len(copies + fringe), pairs  # of two million
    seen = rows.selectExpr("doc_id AS id", "'' AS digest", "text").withColumn("words", nearcopies._words(F.col("text")))
    sketched = seen.select("id", "digest", "words").mapInArrow(nearcopies._sketched, "id long, digest string, n long, keys array<long>, bag binary")
    keys = {r.id: r.keys for r in sketched.collect()}
    linked = 0
    for i, text in enumerate(fringe):
        near = levenshtein(copies[i], text) <= 0.2 * 150
        if near and set(keys[i]) & set(keys[2000 + i]):
            linked += 1
            assert of[i] == of[2000 + i]
    assert linked > 250 and len({of[i] for i in range(2000)}) == 1


def test_open_pairs_are_all_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", 7)
    r = random.Random(3)
    n, bags = 60, {}
    for i in range(n):
        drawn = np.array([r.getrandbits(64) for _ in range(10)], np.uint64)
        bags[i] = nearcopies.bag(drawn if r.random() < 0.5 or not i else np.r_[last[:9], drawn[:1]])
        last = drawn if i % 7 == 0 else last
    rows = [(b, i, 10) for b in range(4) for i in range(n) if b < 3 or i < 3]
    filed = spark.createDataFrame(rows, "bucket long, id long, n long")
    found = spark.createDataFrame([(i, 0) for i in range(0, n, 5)], "node long, component long")
    sized = spark.createDataFrame([(i, 10, bytearray(b.tobytes())) for i, b in bags.items()], "id long, n long, bag binary")
    got = {(x.a, x.b) for x in nearcopies._open_pairs(filed, found, sized, None, 0.8).collect()}
    want = {
        (a, b) for a in range(n) for b in range(a + 1, n)
        if (a % 5 or b % 5) and np.abs(bags[a].astype(int) - bags[b].astype(int)).sum() <= 4
    }
    assert got == want and len(want) > 20


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_candidates_near_the_threshold(share):
    """At least nine of ten pairs share a sketch, edits scattered or evenly spaced."""
    r = np.random.default_rng(5)
    for n in (10, 20, 150, 600):
        for scattered in (True, False):
            missed = 0
            for _ in range(200):
                text = r.integers(0, 1 << 62, n).astype(np.uint64)
                edits = max(1, int(n * share))
                at = r.choice(n, edits, replace=False) if scattered else ((np.arange(edits) + 0.5) * n / edits).astype(int)
                copy = text.copy()
                copy[at] = r.integers(0, 1 << 62, edits).astype(np.uint64)
                with np.errstate(over="ignore"):
                    missed += not (nearcopies.sketch(text) == nearcopies.sketch(copy)).any()
            assert missed <= (20 if share == 0.2 else 4), (n, scattered, missed)


def test_sketches_keep_the_order_of_the_text():
    words = np.random.default_rng(1).integers(0, 1 << 62, 40).astype(np.uint64)
    turned = np.r_[words[20:], words[:20]]
    with np.errstate(over="ignore"):
        one, two = nearcopies.sketch(words, sketches=200), nearcopies.sketch(turned, sketches=200)
    # The k-mers are nearly the same, but half of the pairs stand the other way round.
    assert 0.2 < (one == two).mean() < 0.65


def test_unlike_texts_of_one_key_are_documents_of_their_own(docs):
    alpha, beta = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "beta"))
    rows = [(7, alpha), (7, beta), (8, f"{beta} x"), (7, alpha), (9, alpha)]
    got = near_copies(docs(rows)).collect()
    kept = sorted((r.doc_id, r.digest) for r in got if r.kept)
    assert len(kept) == 3 and len(set(kept)) == 2 and {k for k, _ in kept} == {7}
    assert {r.class_id for r in got} == {7} and sorted(r.class_size for r in got) == [2, 2, 3, 3, 3]


def test_pairs_of_one_large_class(docs, monkeypatch):
    """Few pairs are looked at for each text of a large class, since most of it is connected after a few buckets."""
    r = random.Random(8)
    words = [f"w{r.randrange(5000)}" for _ in range(80)]
    texts = [" ".join(f"x{i}-{k}" if r.random() < 0.04 else w for k, w in enumerate(words)) for i in range(400)]
    seen, allowed = [], nearcopies._allowed

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return allowed(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_allowed", counting)
    assert {c.class_size for c in near_copies(docs(texts)).collect()} == {400}
    assert sum(seen) < 4 * len(texts), seen


def test_open_pair_comes_out_of_one_of_its_buckets():
    """Texts that lie together in many buckets and don't link are one pair, not one in each bucket."""
    r = np.random.default_rng(6)
    n, shared = 40, r.integers(-(1 << 62), 1 << 62, nearcopies.SKETCHES)
    keys = r.integers(-(1 << 62), 1 << 62, (n, nearcopies.SKETCHES))
    for i in range(n):
        at = r.choice(nearcopies.SKETCHES, 30, replace=False)
        keys[i, at] = shared[at]
    keys[0] = shared
    bag = nearcopies.bag(r.integers(0, 1 << 62, 50).astype(np.uint64)).tobytes()
    rows = [{"bucket": b, "low": 0, "high": 0, "tile": 0, "own": i, "id": i, "n": 50, "bag": bag, "keys": keys[i]} for b in shared for i in range(n) if b in keys[i]]
    batch = pa.RecordBatch.from_pylist(rows)
    got = [(a, b) for out in nearcopies._crossed(None, 0.8)([batch.slice(0, 500), batch.slice(500)]) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (keys[a] == keys[b]).any()}
    assert len(want) > 700 and sorted(got) == sorted(want)


def test_components_end_with_stars(spark, monkeypatch):
    """Components that are stars already take no round, and a round takes no more tasks than its edges need."""
    from gridweave.llm import components as module

    names, stored = [], module.stored

    def counting(df, name):
        out = stored(df, name)
        names.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(module, "stored", counting)
    star = spark.createDataFrame([(i % 7, i + 10) for i in range(300)], "a long, b long")
    assert {(x.node, x.component) for x in components(star).collect()} == {(i + 10, i % 7) for i in range(300)} | {(i, i) for i in range(7)}
    assert [n for n, _ in names] == ["edges"]
    names.clear()
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {x.component for x in components(path).collect()} == {0}
    assert len(names) > 1 and max(files for name, files in names[1:]) <= module.TASKS
