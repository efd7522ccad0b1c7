from collections import defaultdict

from pyspark.sql import functions as F

from gridweave.llm.mixing import mix_sources, source_targets, take, word_count


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        level = rest / sum(weight[n] for n in open_) if open_ else 0
        new = {n for n in open_ if level * weight[n] > most * sizes[n]}
        if not new:
            return {n: most * sizes[n] if n in full else level * weight[n] for n in names}
        full |= new


def test_targets_by_filling(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 80}, {"a": 0, "b": 7}, {"z": 3}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in source_targets(df, (3, 1, 2), 1.5, 2).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 * (1 + want[n]) for n in want)


def test_words(spark):
    texts = [None, "", " ", "a", "a b\tc\nd\re\x0bf\x0cg", "x y z", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 0, 1, 7, 2, 1]


def test_mix_is_near_targets(docs):
    rows = [(i, "w " * (1 + i * 7919 % 97), "en", s) for i, s in enumerate(["hot"] * 2000 + ["b"] * 300 + [None] * 300)]
    rows += [(5, "same words here", "en", "hot")] * 3 + [(7000, None, "en", "none"), (7001, "", "en", "none")]
    df = docs(rows).withColumn("words", word_count(F.col("text")))
    mixed = mix_sources(df, size="words")
    out = mixed.collect()
    assert len(out) == len(rows)
    taken, target, biggest = defaultdict(int), {}, defaultdict(int)
    for r in out:
        source = r["row"].source
        taken[source] += r.taken
        target[source] = r.target
        biggest[source] = max(biggest[source], r["size"])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    for source in taken:
        assert abs(taken[source] - target[source]) <= 4 * biggest[source] + 0.03 * target[source]
    again = mix_sources(df.repartition(7), size="words")
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in out)
    emitted = take(mixed)
    assert emitted.columns == df.columns and emitted.count() == sum(r.copies for r in out)


def test_empty(docs):
    assert mix_sources(docs([]).withColumn("words", F.lit(1)), size="words").count() == 0
