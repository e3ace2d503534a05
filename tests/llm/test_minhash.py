import random
import re

import numpy as np
import pytest

from tesserae.llm import minhash as M
from tesserae.llm.jaccard import Shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row; rows are nodes."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and None not in (rows[a][0], rows[b][0]) and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    out = [(i, len(s), None if i is None else least[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéÀZ.") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    line = text(40)
    rows = []
    for _ in range(50):
        rows.append(text(rng.choice([1, 2, 3, 4, 5, 20, 60, 200])) + (line if rng.random() < 0.6 else []))
        for _ in range(rng.choice([0, 0, 1, 2, 10])):
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(copy) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            rows.append(copy)
    base = text(150)  # a family around the threshold: some link to some others only
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        rows.append(copy)
    rng.shuffle(rows)
    out = [(i, rng.choice(["  ", "\n", " "]).join(w)) for i, w in enumerate(rows)]
    more = [(9000, None), (9001, ""), (9002, " \t"), (9003, "w " * 40_000), (9004, "W x"), (9005, "w X"), (None, out[0][1]), (out[0][0], out[0][1]), (out[1][0], out[9][1] + " end")]
    return out + more


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, node int").repartition(3)
    got = M.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(*r[:3], True) if r[0] is None else r for r in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_links_that_no_leader_has(spark, monkeypatch):
    """Leaders that link with nothing: all links come from step 3."""
    rows = corpus(4)
    monkeypatch.setattr(M, "verified", lambda pairs, sets: pairs.limit(0))
    monkeypatch.setattr(M, "BLOCK", 16)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(*r[:3], True) if r[0] is None else r for r in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_id_with_two_texts(spark):
    rng = random.Random(1)
    a, b = ([rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "x"]))]
    assert {r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_tell_similarity():
    """Estimates of known similarities are unbiased, and none of 80 per cent is thrown away."""
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9, 0.5):
        both, apart = [], []
        for _ in range(200):
            n = 400
            common_ones = int(round(2 * n * share / (1 + share)))
            x = rng.integers(1, 1 << 63, 2 * n - common_ones, dtype=np.uint64)
            sig = np.array([M.samples(x[:n]), M.samples(x[n - common_ones :])])
            both.append((sig[0] == sig[1]).mean())
            s = M.sketches(sig)
            apart.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
        assert abs(np.mean(both) - share) < 0.01
        estimate = 1 + M.BITS * np.log(1 - 2 * np.mean(apart) / M.BITS) / 2 / (2 * M.SAMPLES)
        assert abs(estimate - share) < 0.015
        if share >= 0.8:
            assert max(apart) <= M.FARTHEST
        else:
            assert min(apart) > M.FARTHEST


def test_samples_in_chunks():
    tokens = Shingles(4)([" ".join(str(k % 1700) for k in range(5000)).encode()])[0]
    whole = np.min((tokens[:, None] ^ M._FLIP) * M._ODD, axis=0) >> np.uint64(32)
    assert (M.samples(tokens) == whole).all()


def test_a_family_makes_few_pairs(spark, monkeypatch):
    """300 near copies have 50 buckets in common; with a leader for each of them there were more than 30 pairs a document."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    counted, screened = [], M.screened
    monkeypatch.setattr(M, "screened", lambda pairs, nodes: counted.append(pairs.count()) or screened(pairs, nodes))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert 299 <= counted[0] <= 300 * 10
