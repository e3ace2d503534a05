import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tesserae.llm import alignment as A
from tesserae.llm import common

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """By whole texts, token pairs and the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    va, vb = A.vocabulary_a(PATHS[0]), A.vocabulary_b(two)
    out, seen = [], Counter()
    for i, text in rows:
        a, b = [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            want = (" " + text).encode()
            if b"".join(va[x] for x in a) != want or b"".join(vb[x] for x in b) != want:
                a, b = [], []
        groups, x, y, ea, eb = [], 0, 0, 0, 0
        while x < len(a):
            ga, gb = [a[x]], [b[y]]
            ea, eb, x, y = ea + len(va[a[x]]), eb + len(vb[b[y]]), x + 1, y + 1
            while ea != eb:
                if ea < eb:
                    ga.append(a[x])
                    ea, x = ea + len(va[a[x]]), x + 1
                else:
                    gb.append(b[y])
                    eb, y = eb + len(vb[b[y]]), y + 1
            groups.append((ga, gb))
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        seen.update(links.keys())
        out.append((i, a, b, groups, links))
    top = {}
    for (p, _), k in seen.items():
        top[p] = max(top.get(p, 0), k)
    rows = []
    for i, a, b, groups, links in out:
        digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(m for p, m in links.items() if seen[p] == top[p[0]])
        rows.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(m * seen[p] for p, m in links.items()), hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    return sorted(rows, key=str)


def hostile():
    rng = random.Random(2)
    pieces = ["the", "The ", " ", "  ", "\n", "\n\n ", "\t", " \n", "é", "ü中文字", "\U0001f600‍\U0001f525", "don't", "'s", "12345", "x" * 70, "!!!", "---", "　", "  ", "<s>", "<|endoftext|>", "</s> ", "\x00", "\x1c ", "\x85", "naïve", "ﬁ", "Á", "\r\n", "def f(x):\n    return x", "  a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 8, 40]))) for _ in range(250)]
    texts += [None, "", " ", "   ", "\n", "a", " a", "a ", "a  ", "▁", "a ▁ b", "<unk>", "word " * 5000, "y" * 20_000, "的" * 3000, texts[0], texts[0]]
    return list(enumerate(texts)) + [(None, "no id"), (3, "again an id")]


def test_against_whole_texts(spark):
    rows = hostile()
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_a long, block string").repartition(3)
    got = A.alignments(df, *PATHS)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("run", [1, 300])
def test_small_blocks(monkeypatch, run):
    """Cutting into blocks changes nothing but which pairs are counted together, nor do the texts that units are encoded in."""
    import duckdb

    models, con = A.tokenizers(*PATHS), duckdb.connect()
    texts = [(t or "").encode() for _, t in hostile()]
    whole, _ = A.aligned(texts, models, con)
    monkeypatch.setattr(A, "RUN", run)
    for k in range(0, len(texts), 7):
        part, pairs = A.aligned(texts[k : k + 7], models, con)
        for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
            assert part[name] == whole[name][k : k + 7]
        assert sum(map(len, part["pairs"].to_pylist())) == sum(pairs["k"].to_pylist())


def test_bytes_that_are_not_text():
    import duckdb

    found, pairs = A.aligned([b"\xff\xfe", b"fine"], A.tokenizers(*PATHS), duckdb.connect())
    assert found["n_a"][0] == 0 and found["n_a"][1] > 0 and found["groups_sha256"][0] == ""


def test_empty_table(spark):
    assert A.alignments(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, A.op12_alignment(spark, sf).collect()), key=str) == brute(rows)
