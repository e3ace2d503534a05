import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import quality as Q


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, kinds = [], {}
    for i in range(n):
        words, kind = [rng.choice(pool) for _ in range(rng.randrange(20, 120))], rng.choice(["good"] * 6 + ["toxic", "junk"])
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vlk" + rng.choice("abcdefg") + rng.choice("xyz"))
            words[3] = "vlkk"
        if kind == "junk":
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        kinds[i] = kind
    return rows, kinds


def test_held_out_accuracy(spark):
    rows, kinds = corpus()
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "z" * 300_000)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as log_weight")
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in kinds.items() if i % 2] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = Q.accepted(df, labels)
    assert got.columns == df.columns
    kept = {r.doc_id for r in got.collect()}
    held = [i for i in kinds if i % 2 == 0]
    good = [i for i in held if kinds[i] == "good"]
    bad = [i for i in held if kinds[i] != "good"]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * len(bad)
    assert {900, 901} <= kept


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.accepted(df, none).count() == 2
    assert Q.accepted(df.limit(0), none).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    vals = [rng.choice([rng.gauss(0, 100), 5.0, 7.25]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for k in (1, 2, 500, 1500, 3000):
        assert Q.kth_largest(df, "v", k, small=5) == sorted(vals, reverse=True)[k - 1]


def test_features_do_not_depend_on_block():
    rows, _ = corpus(50, 4)
    texts = [t.encode() for _, t in rows]
    b, d = Q.Features()(texts)
    one = [set(Q.Features()([t])[0].tolist()) for t in texts]
    assert [set(b[d == i].tolist()) for i in range(len(texts))] == one


def test_separating():
    assert Q.separating(np.array([3.0, 2.0, -1.0]), np.array([True, True, False])) == 0.5
    assert Q.separating(np.array([]), np.array([], bool)) == -np.inf


def test_draw_follows_the_weights(spark):
    """Share of each weight among the k drawn, against drawing one by one without replacement."""
    n, k, rng = 6000, 2000, np.random.default_rng(5)
    weights = np.array([-2.0, -0.5, 0.0, 1.5])[np.arange(n) % 4]
    odds, brute = np.exp(weights / Q.TEMPERATURE), np.zeros(4)
    for _ in range(40):
        drawn = rng.choice(n, k, replace=False, p=odds / odds.sum())
        brute += np.bincount(drawn % 4, minlength=4) / 40
    got = np.zeros(4)
    for seed in range(10):
        df = spark.createDataFrame([(seed * n + i, float(w)) for i, w in enumerate(weights)], "doc_id long, w double")
        keys = df.select("doc_id", Q.draw_key(F.col("w")).alias("key"))
        cut = Q.kth_largest(keys, "key", k)
        ids = [r.doc_id for r in keys.where(F.col("key") >= cut).collect()]
        assert len(ids) == k
        got += np.bincount(np.array(ids) % n % 4, minlength=4) / 10
    assert np.abs(got - brute).max() < 0.02 * k, (got, brute)
