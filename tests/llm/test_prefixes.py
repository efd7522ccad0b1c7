"""The trie of conversations against one built by hand."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gridweave.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, least string, path string"


def turns(rows):
    """Turns in order; those of one number by digest, as the operator says."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            one = (role or "", text or "")
            digest = hashlib.sha256(f"{len(one[0])}:{one[0]}{one[1]}".encode()).hexdigest()
            out[conv].append((turn is not None, turn or 0, digest[:32], one))
    return {c: [x[3] for x in sorted(found)] for c, found in out.items()}


def rebuilt(own):
    out = {}
    for c, mine in own.items():
        base = c - c % 5 if c >= 0 else c - -(-c % 5)
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def plain_trie(sequences):
    members, ended = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ended[tuple(s)].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, ends))
    return sorted(out, key=repr)


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)

    return make


@pytest.fixture
def rows():
    rng = random.Random(3)
    said = [("user", "a"), ("user", "Ä"), ("bot", "bb"), ("bot", ""), (None, None), ("", "")]
    out = []
    for c in range(-8, 90):
        if c % 7:
            out += [(c, rng.choice([t, t, None, 0]), *rng.choice(said[:3] if t < 3 else said)) for t in range(rng.randrange(1, 14))]
    out += [(c, t, "user", "same") for c in range(200, 240) for t in range(4)]
    out += [(300, t, "user", "a") for t in range(120)] + [(301, t, "user", "a") for t in range(150)]
    return [*out, (None, 1, "user", "a"), out[0], out[0]]


@pytest.mark.parametrize(("block", "parts"), [(1 << 16, 8), (3, 8), (1, 3)])
def test_all_nodes(table, rows, monkeypatch, spark, block, parts):
    sequences = prefixes.turns_of(table(rows))
    plain = plain_trie(turns(rows))
    if block > 1000:
        out = prefixes.prefix_trie(sequences)
        assert sorted(map(tuple, out.collect()), key=repr) == plain
        return
    monkeypatch.setattr(prefixes, "_blocks", small_blocks(block))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, prefixes.prefix_trie(sequences).collect()), key=repr) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def small_blocks(size):
    """Blocks of a few rows each."""

    def run(batches):
        from gridweave.llm import prefixes

        prefixes.ROWS = size
        yield from prefixes._blocks(batches)
        prefixes.ROWS = 1 << 16

    return run


def test_branched_conversations(table, rows):
    key = F.col("key")
    made = prefixes.branched(prefixes.turns_of(table(rows)), key - key % 5, F.crc32(key.cast("string").cast("binary")) % 9, most=8)
    out = prefixes.prefix_trie(made)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_trie(rebuilt(turns(rows)))


def test_ids_of_one_sequence_in_chunks(table, monkeypatch):
    def small_chunks(batches):
        from gridweave.llm import prefixes

        prefixes.CHUNK = 40
        yield from prefixes._joined(batches)
        prefixes.CHUNK = 1 << 20

    rows = [(c, 0, "user", "hi") for c in range(500)]
    monkeypatch.setattr(prefixes, "_joined", small_chunks)
    out = prefixes.prefix_trie(prefixes.turns_of(table(rows)))
    assert sorted(map(tuple, out.collect()), key=repr) == plain_trie(turns(rows))


def test_empty_tables(table):
    assert prefixes.prefix_trie(prefixes.turns_of(table([]))).count() == 0
    assert prefixes.prefix_trie(prefixes.turns_of(table([(None, 0, "a", "b")]))).count() == 0
