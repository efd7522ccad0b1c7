import numpy as np
import pytest

from gridweave.llm import licenses
from gridweave.llm.licenses import CONTAINED, TEMPLATES, bands, scan_licenses, shingles


def grams(text):
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_against_all_windows(docs):
    noise = " ".join(f"n{i}" for i in range(300))
    long_one = TEMPLATES["mit-grant"]
    changed = long_one.replace("free of charge", "at no cost").replace("sublicense", "rent")
    texts = [
        f"{noise} {TEMPLATES['mit-name']} {noise}", TEMPLATES["cc-by-nc-4.0-name"], f"x {long_one}\n{noise} {long_one}", f"{noise} {changed} {noise}",
        " ".join(long_one.split()[:30]), noise, None, "", "MIT", TEMPLATES["apache-2.0-header"], f"{TEMPLATES['mit-name']} {TEMPLATES['mit-name'].upper()}",
    ]
    got = scan_licenses(docs(texts)).collect()
    found = {(r.doc_id, r.license) for r in got}
    want = set()
    for i, text in enumerate(texts):
        have = grams(text or "")
        for name, template in TEMPLATES.items():
            own = set(grams(template))
            width = -(-3 * len(own) // 2)
            if any(len(own & set(have[s : s + width])) >= CONTAINED * len(own) for s in range(len(have))):
                want.add((i, name))
    assert found == want and (3, "mit-grant") in found and (4, "mit-grant") not in found
    assert sum(r.doc_id == 2 and r.license == "mit-grant" for r in got) == 2
    row = next(r for r in got if r.doc_id == 0)
    assert (row.license, row.containment, row.first_word, row.n_words) == ("mit-name", 1.0, 300, 5)


def test_odd_tables(docs):
    rows = [(None, TEMPLATES["mit-name"]), (3, TEMPLATES["mit-name"]), (3, TEMPLATES["mit-name"])]
    assert sorted((r.doc_id is None, r.doc_id) for r in scan_licenses(docs(rows)).collect()) == [(False, 3), (False, 3), (True, None)]
    assert scan_licenses(docs([])).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(docs([]), templates={"short": "too few words"})


def test_bands_follow_similarity():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 60, 200).astype(np.uint64)
    g = shingles(words)
    assert (bands(g) == bands(np.r_[g, g])).all() and not (bands(g) == bands(g + np.uint64(1))).any()


def test_bands_find_a_fifth_changed():
    r = np.random.default_rng(8)
    missed = 0
    for _ in range(2000):
        template = r.integers(0, 1 << 63, 100).astype(np.uint64)
        window = np.r_[template[:80], r.integers(0, 1 << 63, 70).astype(np.uint64)]
        missed += not (bands(template) == bands(window)).any()
    assert missed <= 5


def test_a_table_of_templates(spark, docs):
    """Hundreds of wordings of a few sizes, some nearly alike, against all windows."""
    r = np.random.default_rng(3)
    wordings, texts = {}, []
    for t in range(300):
        n = int(r.choice([8, 8, 20, 45]))
        wordings[f"t{t:03}"] = " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    wordings["t300"] = wordings["t000"] + " and more"
    for d in range(80):
        parts = []
        for t in r.integers(0, 301, 3):
            words = wordings[f"t{t:03}"].split()
            if d % 2:
                words[int(r.integers(len(words)))] = "other"
            parts += [f"n{x}" for x in r.integers(0, 10**6, int(r.integers(0, 60)))] + words
        texts.append(" ".join(parts))
    table = spark.createDataFrame([(n, t, 1) for n, t in wordings.items()], "name string, text string, bands int")
    found = {(x.doc_id, x.license) for x in scan_licenses(docs(texts), templates=table).collect()}
    want = set()
    for i, text in enumerate(texts):
        have = grams(text)
        for name, template in wordings.items():
            own = set(grams(template))
            if not own & set(have):
                continue
            width = -(-3 * len(own) // 2)
            if any(len(own & set(have[s : s + width])) >= CONTAINED * len(own) for s in range(len(have))):
                want.add((i, name))
    assert found == want and len(want) > 100
    assert {x.license for x in scan_licenses(docs([wordings["t300"]]), templates=table).collect()} == {"t000", "t300"}


def test_tables_that_are_refused(spark, docs, monkeypatch):
    wording = TEMPLATES["mit-name"]
    for rows in ([("a", wording), ("a", wording)], [(None, wording)], [("a", None)]):
        with pytest.raises(ValueError):
            scan_licenses(docs([wording]), templates=spark.createDataFrame(rows, "name string, text string"))
    assert scan_licenses(docs([wording]), templates={}).count() == 0
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 1)
    with pytest.raises(ValueError):
        scan_licenses(docs([wording]))


def test_bands_retrieve():
    """Without its bands in the index no template is found, whatever shingles a text has."""
    from gridweave.llm.licenses import Library

    words = np.random.default_rng(5).integers(0, 1 << 62, 40).astype(np.int64)
    library = Library({"one": words.tolist()})
    own = shingles(words.view(np.uint64))
    assert [x[0] for x in library.scan(own, library.hits(own))] == ["one"]
    size, known, keys, owners = library.sizes[0]
    library.sizes = [(size, known, keys + np.uint64(1), owners)]
    assert library.scan(own, library.hits(own)) == []
