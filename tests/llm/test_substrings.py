import hashlib
import random
from collections import Counter

import pytest

from tesserae.llm import substrings as S


def brute(texts, t):
    count = Counter(x[i : i + t] for x in texts for i in range(len(x) - t + 1))
    out = []
    for x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - t + 1):
            if count[x[i : i + t]] > 1:
                gone[i : i + t] = [True] * t
        out.append((len(x), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(x, gone) if not g)))
    return out


def corpus(seed, t):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passages = [piece(rng.randrange(t // 2, 3 * t)) for _ in range(6)]
    texts = []
    for _ in range(60):
        x = "".join(rng.choice(passages) if rng.random() < 0.5 else piece(rng.randrange(2 * t)) for _ in range(rng.randrange(4)))
        texts.append(x)
    texts += ["a" * (3 * t), "ab" * t, texts[0] + "x", texts[0], texts[0], "", None, "q" * (t - 1), "q" * t, piece(4 * t) * 2]
    base = piece(8 * t)
    for _ in range(8):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    return texts


@pytest.mark.parametrize("t,k,step,segment", [(20, 6, 4, 1 << 18), (24, 11, 5, 64), (200, 64, 16, 1 << 18)])
def test_against_brute_force(spark, monkeypatch, t, k, step, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    texts = corpus(t, t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as first", "2 as h")
    got = {r.doc_id: r for r in S.deduplicated(df, t, k, step).collect()}
    want = brute([(x or "").encode() for x in texts], t)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, sum(s["end"] - s["first"] for s in r.removed), len(r.removed), bytes(r.kept)) == w, i


def test_repeated_rows_and_empty(spark):
    x = "abcdefghij" * 3 + "".join(chr(33 + i % 90) for i in range(0, 900, 7))
    df = spark.createDataFrame([(1, x), (1, x), (None, None)], "doc_id long, text string")
    got = S.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got) == sorted([(0, 0)] + [(1, 0 if len(x) >= 200 else len(x))] * 2)
    assert S.deduplicated(df.limit(0)).count() == 0


def test_null_and_equal_ids_with_different_texts(spark):
    rng = random.Random(9)
    piece = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    long, short, other = piece(900), piece(250), piece(400)
    texts = [long, short, other, long + other, piece(30), None]
    for ids in ([None] * 6, [7] * 6, [1, 1, None, 2, None, None]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        want = brute([(x or "").encode() for x in texts], 200)
        got = [(r.n_bytes, sum(s["end"] - s["first"] for s in r.removed), len(r.removed), bytes(r.kept)) for r in S.deduplicated(df).collect()]
        assert sorted(got) == sorted(want)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    x = "".join(rng.choice("abcdef") for _ in range(500))
    rows = [(1, x), (2, "zz" + x[100:400] + "yy"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([(t or "").encode() for _, t in rows], 200)
    for r in S.op1_substrings(spark, str(tmp_path)).collect():
        n, gone, spans, kept = want[r.doc_id - 1]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
