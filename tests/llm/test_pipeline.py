import corpus_pipeline
from gridweave.llm.common import stored
from gridweave.llm.packing import pack


def test_stages_take_effect(spark, docs):
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "other ")
    passage = " ".join(f"shared{i}" for i in range(30))
    own = " ".join(f"own{i}" for i in range(20))
    rows = [(1, base, "en", "a"), (2, near, None, "a"), (3, f"{passage} und so weiter", "de", "b"), (4, f"{own} {passage}", "en", None)]
    rows += [(5, None, "en", "a"), (6, "123 456", "en", "a"), (7, base, "en", "a"), (None, "no id but text", "en", "a"), (3, f"{passage} und so weiter", "de", "b")]
    frame = docs(rows)
    out, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, "unused"), name)
        if name != "packing":
            assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
        seen[name] = out.collect()
    assert sorted(str(r.doc_id) for r in seen["language"]) == ["1", "2", "3", "3", "4", "7", "None"]
    assert all(r.lang for r in seen["language"])
    assert sorted(str(r.doc_id) for r in seen["near_copies"]) == ["1", "3", "4", "None"]
    texts = {r.doc_id: r.text for r in seen["repeats"]}
    assert texts[1] == base and texts[4].strip() == own and all(r.n_chars == len(r.text) for r in seen["repeats"])
    taken = sum(len(r.text.split()) for r in seen["mixing"])
    whole = sum(len(t.split()) for t in texts.values())
    assert abs(taken - 1.5 * whole) <= 0.5 * whole
    assert sum(r.length for r in seen["packing"]) == sum(r.length for r in pack(spark.createDataFrame(seen["mixing"], frame.schema)).collect())


def test_unlike_texts_of_one_id_stay(spark, docs):
    alpha, beta = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "beta"))
    frame = docs([(7, alpha), (7, beta), (8, f"{beta} x"), (7, alpha), (None, beta), (9, " "), (9, " ")])
    out = corpus_pipeline.drop_near_copies(spark, frame, "unused")
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("7", alpha), ("7", beta), ("None", beta), ("9", " "), ("9", " ")])


def test_empty(spark, docs):
    out = docs([], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, "unused"), name)
    assert out.count() == 0


def test_registered(spark):
    from __spark_entry__ import oracle_sql, queries

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()
