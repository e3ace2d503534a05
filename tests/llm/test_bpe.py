import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    yield from ("", " ", "a", "A", "It's we'LL don't 12345 ½ ² ", "x" * 30_000, "ab" * 9000, "é" * 5000, "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|><|endoftext|", "ΑΣ ΣΑΣ", "İstanbul", "\x1c\x1da\x85b c　d​e", "é ẛ̣", "</w> w</w>", "\U0001f44d\U0001f3fd!!", "中文字 ไทย")
    for _ in range(300):
        yield "".join(rng.choice("abcdeinrst    'é!%.0\nŞßΣ") for _ in range(rng.randrange(200)))
    for _ in range(100):
        yield "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x20000)])) for _ in range(60)).encode("utf-8", "ignore").decode()


def test_same_as_library(reference):
    own = bpe.WordBpe(bpe.load(PATH))
    all_texts = list(texts())
    for text, got in zip(all_texts, own.encode(all_texts)):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, text[:80]
        assert own.decode(got) == reference.decode(ids, skip_special_tokens=False)


def test_every_letter(reference):
    own = bpe.WordBpe(bpe.load(PATH))
    chars = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 16 == 3)]
    got = own.encode(chars)
    want = [np.array(x.ids, "<u4").tobytes() for x in reference.encode_batch(chars, add_special_tokens=False)]
    assert [hex(ord(c[1])) for c, g, w in zip(chars, got, want) if g != w] == []


def test_frame(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(-1, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "'x' as ids", "1 as decoded")
    got = bpe.encoded(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert bytes(by[i].ids) == np.array(ids, "<u4").tobytes()
        assert by[i].decoded == reference.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(df.limit(0)).count() == 0


def test_query(spark, reference, tmp_path):
    rows = [(1, "The thatonre, 12 it's"), (2, None), (3, "The thatonre, 12 it's")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op9_bpe(spark, str(tmp_path)).collect():
        ids = reference.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
