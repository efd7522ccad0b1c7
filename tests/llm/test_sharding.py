from collections import Counter

import pytest

from gridweave.llm.sharding import lookup_table, shard_rows, write_shards

NAMES = ["a", "b", "c", "d"]


def test_table_is_even_and_stable():
    table = lookup_table(NAMES, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_table(NAMES[:3], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 3)
    assert moved < 0.25 * 1009


def test_shards_take_turns():
    seen = lookup_table(NAMES, 11)
    assert sorted(Counter(seen).values()) == [2, 3, 3, 3]
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(wrong, 11)
    with pytest.raises(ValueError):
        lookup_table(NAMES, 12)


def test_rows_keep_their_shard(docs, tmp_path):
    df = docs([(1, "x"), (1, "y"), (None, "z"), *[(i, "t") for i in range(2, 400)]])
    out = shard_rows(df, ["doc_id"], NAMES, 1009)
    rows = out.collect()
    assert len(rows) == 401 and {r["row"].key for r in rows} == {"x"}
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert set(Counter(r.shard for r in rows)) == set(NAMES)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    write_shards(out.select("shard", out["row"]), str(tmp_path / "out"), 2)
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={n}" for n in NAMES]
    assert shard_rows(docs([]), ["doc_id"], NAMES, 1009).count() == 0
    with pytest.raises(ValueError):
        shard_rows(df, ["row"], NAMES, 1009)
