import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from gridweave.llm.packing import Encoder, pack, public_encoder, unpack

TEXTS = ["one two three", None, "", "a" * 9000, "naïve 汉字 and 日本", "a <|endoftext|> b<|endoftext|>", "é <|endoftext|>", "one two three", " \n\t x" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_both_libraries_agree(tokenizer):
    encode = Encoder(**public_encoder())
    for text in ["It's 12,345!  two  spaces\n\n\tand tabs ", "Größe, déjà vu — “quotes”", *filter(None, TEXTS)]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("length", [7, 64])
def test_pieces_hold_every_id_once(docs, tokenizer, length):
    df = docs([(9, TEXTS[0]), *enumerate(TEXTS)]).repartition(3)
    pieces = pack(df, length=length)
    rows = pieces.collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in [*enumerate(TEXTS), (9, TEXTS[0])]}
    for key, ids in want.items():
        own = sorted((r.start, r) for r in rows if r.doc_id == key)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for _, r in own]).tolist() == ids
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for _, r in own)
        assert [s for s, _ in own] == np.cumsum([0] + [r.length for _, r in own])[:-1].tolist()
    total = sum(map(len, want.values()))
    for s in range(-(-total // length)):
        at = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in at] == np.cumsum([0] + [n for _, n in at])[:-1].tolist()
        size = sum(n for _, n in at)
        assert size == (length if s < total // length else total % length)
        assert {r.padded_length for r in rows if r.sequence_id == s} == {size if size.bit_count() == 1 else length}


def test_query_columns_and_empty_table(spark, docs, tmp_path):
    from gridweave.llm.queries import op1_packing

    docs(TEXTS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_packing(spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "start"] and {"ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    row = next(r for r in out.collect() if r.doc_id == 1)
    assert row.ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
    assert pack(docs([])).count() == 0
