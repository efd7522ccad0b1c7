import duckdb
import numpy as np
import zlib

from gridweave.llm import language


def test_families_and_features():
    assert language.family_of("de") == language.family_of("en-GB") == "germanic" and language.family_of("xx") == "xx"
    assert language.features(None) is None and language.features("12 .. ") is None
    assert (language.features("Ab c") == language.features("ab  C!")).all()


def test_machines_within_families():
    rng = np.random.default_rng(1)
    words = {"en": "the of and with", "de": "der und die mit", "fr": "le et les avec", "es": "el y los con"}
    texts = [(k, " ".join(rng.choice(v.split(), 30))) for k, v in words.items() for _ in range(20)]
    x = np.array([language._scaled(language.features(t)) for _, t in texts], np.float32)
    model = language.Model.fit([k for k, _ in texts], x)
    assert model.pairs == [("germanic", "romance"), ("de", "en"), ("es", "fr")]
    assert all(model.predict(language.features(t))[0] == k for k, t in texts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    from gridweave.llm.queries import op6_language

    got = {r.doc_id: r for r in op6_language(spark, sf).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in truth if got[i].held_out and truth[i]]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_odd_rows(docs):
    df = docs([(0, "the of and", "en", "s"), (1, None), (2, "123"), (None, "the cat", None, "s"), (0, "the of and", "en", "s"), (5, "le la les", "fr", "s")])
    rows = language.identify(df, carry=True).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id in (1, 2)} == {(1, "und"), (2, "und")}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und") and {r["row"].key for r in rows} == {"x"}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    unlabelled = language.identify(docs([(0, "words here", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    assert language.identify(docs([])).count() == 0


def test_fitting_copies_rows_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.random((1200, 1 << language.BITS), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = ["en", "de"] * 300 + ["fr", "es"] * 300
    tracemalloc.start()
    language.Model.fit(labels, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.6 * x.nbytes
