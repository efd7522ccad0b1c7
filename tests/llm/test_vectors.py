import duckdb
import numpy as np
import pytest

from gridweave.llm import nearvectors, topk
from gridweave.llm.nearvectors import near_vectors
from gridweave.llm.queries import LLM_ORACLES
from gridweave.llm.topk import MTree, top_scores

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = []
    for i in range(260):
        centre = r.normal(size=6) if i % 4 == 0 else out[-1][1] + r.normal(size=6) * r.choice([0.0, 0.05, 0.2, 0.35])
        out.append([i * 10 if i % 9 else i * 100, np.asarray(centre, np.float32), int(i // 4 % 3)])
    out = [(int(k) + (n % 2), v.tolist(), c) for n, (k, v, c) in enumerate(out)]
    out += [(k + 70_000, v, c) for k, v, c in out[:30]]
    odd = [(90_000, None, 1), (90_100, [], 1), (90_200, [0.0] * 6, 1), (90_300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (90_400, [NAN] * 6, 1), (90_500, [INF] * 6, 1)]
    odd += [(90_600, [1.0] * 6, None), (90_700, [1.0, 2.0], 1), (90_800, [2.0, 1.0], 1), (90_900, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 2), (91_000, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 2)]
    seen = {}
    return [r for r in out + odd if seen.setdefault(r[0], r) is r]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' AS id", "'x' AS vector", "'x' AS cell", "'x' AS pivot", "'x' AS kind", "1 AS fits")


def oracle(df, name, path):
    df.write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return sorted(con.execute(LLM_ORACLES[name]).fetchall())


def test_near_vectors(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(nearvectors, "TILE", 16)
    monkeypatch.setattr(nearvectors, "ROWS", 5)
    df = frame(spark, rows)
    got = near_vectors(df.repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == oracle(df.select("vec_id", "embedding", "label"), "op8_near_vectors", tmp_path)
    assert near_vectors(frame(spark, [])).count() == 0


def test_null_and_repeated_keys(spark):
    df = frame(spark, [(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])
    got = [tuple(r) for r in near_vectors(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True)], key=repr)


def test_error_bounds_hold():
    r = np.random.default_rng(1)
    unit = r.normal(size=(80, 9)) * r.exponential(size=(1, 9))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    codes, scales, errors = nearvectors.quantise(unit)
    product = (codes.astype(float) @ codes.T) * scales[:, None] * scales
    assert (np.abs(product - unit @ unit.T) <= errors[None, :] * (1 + errors[:, None]) + errors[:, None] + 1e-12).all()


def test_top_scores(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 32)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "QUERIES", 8)
    df = frame(spark, rows)
    got = top_scores(df.repartition(3), df["vec_id"] % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == oracle(df.select("vec_id", "embedding", "label"), "op4_top_scores", tmp_path)


def test_rows_of_one_key_are_candidates(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 16)
    more = [(1, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (777_100, [1.0, 0.0], 1), (777_300, [1.0, 1.0], 1), (777_300, [0.5, -1.0], 1)]
    more += [(k - k % 20, v, c) for k, v, c in rows[::3] if v and len(v) == 6]
    df = frame(spark, [*more, *more[5:9]])
    got = sorted(map(tuple, top_scores(df, df["vec_id"] % 100 == 0).collect()))
    assert (777_100, 1, 1, 1024 * 2048) in got and got == oracle(df.select("vec_id", "embedding", "label"), "op4_top_scores", tmp_path)


def test_given_types_stay(spark, tmp_path):
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 3))
    base = np.concatenate([base, base + r.normal(size=base.shape) * 1e-9, base * 1e150, base * 1e-160])
    edge = [[0.93, float(np.sqrt(1 - 0.93**2))], [1.0, 0.0], [1e39, 1.0], [2e39, 0.0], [0.92999999999, 0.36756]]
    table = [(i, [float(x) for x in v], "ab c"[i % 3]) for i, v in enumerate(base[:80])] + [(1000 + i, v, "É") for i, v in enumerate(edge)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, near_vectors(df).collect())) == oracle(df, "op8_near_vectors", tmp_path)
    far = spark.createDataFrame([(i, [float(x) for x in v], "a") for i, v in enumerate(base)], df.schema)
    roots = {x.vec_id: x.component_id for x in near_vectors(far).collect()}
    assert all(roots[i] == roots[i + 80] == roots[i + 120] for i in range(40))


def test_tiles_meet_in_blocks(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(nearvectors, "TILE", 4)
    monkeypatch.setattr(nearvectors, "BLOCK", 3)
    df = frame(spark, rows)
    assert sorted(map(tuple, near_vectors(df).collect())) == oracle(df.select("vec_id", "embedding", "label"), "op8_near_vectors", tmp_path)


def test_few_candidates(spark):
    few = frame(spark, [(100, [1.0, 2.0], 1), (101, [2.0, 1.0], 1), (102, [2.0, 1.0], 1), (None, [9.0, 9.0], 1)])
    got = [tuple(r) for r in top_scores(few, few["vec_id"] % 100 == 0).collect()]
    assert got == [(100, 1, 101, 4 * 1024 * 1024), (100, 2, 102, 4 * 1024 * 1024)]
    none = frame(spark, [])
    assert top_scores(none, none["vec_id"] % 100 == 0).count() == 0


def test_tree_avoids_work():
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 4)) * 30_000
    points = np.concatenate([c + r.normal(size=(50, 4)) * 50 for c in centres]).astype(np.int64)
    tree = MTree.build(np.arange(len(points)), points)
    assert (tree.leaf.sum() > 20) and (tree.radius[0] >= tree.radius[1:]).mean() > 0.9
    for q in points[::97]:
        want = sorted(((int(p @ q), -i) for i, p in enumerate(points)), reverse=True)[:5]
        assert tree.search(q, 5, None) == [(s, -i) for s, i in want]
