import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts or (id, text) or (id, text, lang, source), with columns that clash with private names."""

    def make(rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *["en", "a"][len(r) - 2 :]) if len(r) < 4 else r
            full.append((*r, len(r[1]) if r[1] is not None else None))
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("id", "key", "row", "batch", "kind", "size", "copies", "part", "bucket", "label", "data"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
