import random

import numpy as np

from tesserae.llm import decontaminate as D


def brute_score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = D.MATCH if item[i - 1] == text[j - 1] else D.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_smith_waterman():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(0, 6) for _ in range(rng.randrange(1, 25))])
        score, first, end = D.smith_waterman(a, b)
        assert score == brute_score(a, b)
        if score:
            assert brute_score(a, b[first:end]) == score


def planted(seed=2):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    text = lambda n: [rng.choice(pool[:20] if rng.random() < 0.5 else pool) for _ in range(n)]
    items = [(i, text(rng.randrange(15, 40))) for i in range(30)]
    docs, leaked = [], set()
    for d in range(200):
        words = text(rng.randrange(10, 300))
        if d % 4 == 0:
            i, item = items[d % 30]
            item = list(item)
            if d % 8 == 0:  # edited: one word in ten
                for k in range(0, len(item), 10):
                    item[k] = "zz"
            at = rng.randrange(len(words))
            words[at:at] = item
            leaked.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(t).capitalize() + ".") for i, t in items], leaked


def test_planted(spark):
    docs, items, leaked = planted()
    docs += [(900, None), (901, ""), (902, "q " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (None, "x y z"), (72, "Short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert got == leaked
    left = D.decontaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in leaked}
    assert D.leaks(df.limit(0), bench).count() == 0
    assert D.decontaminated(df, bench.limit(0)).count() == len(docs)


def test_repeated_items_and_texts(spark):
    docs, items, leaked = planted()
    rows = [*docs, *docs[:8], (None, docs[0][1])]
    bench = [*items, items[0], (500, items[1][1])]
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).where("doc_id is not null").collect())
    want = [(d, i) for d, i in leaked for _ in range(1 + (d < 8))]
    want += [(d, i) for d, i in want if i == 0] + [(d, 500) for d, i in want if i == 1]
    assert got == sorted(want)


def test_few_bits_and_groups_change_nothing(spark, monkeypatch):
    """Bitmaps that let nearly all through, and groups of one item."""
    monkeypatch.setattr(D, "BITS", 64)
    monkeypatch.setattr(D, "GROUP", 1)
    docs, items, leaked = planted(5)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()} == leaked
    assert {r.doc_id for r in D.decontaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in leaked}


def test_seeds_miss_nothing(spark):
    """Random items and texts of few words, scored by brute force; every pair that scores enough shares a seed, by words and by n-grams."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([6, 26])])
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 16)))) for k in range(60)]
    texts = []
    for d in range(150):
        words = [word() for _ in range(rng.randrange(0, 25))]
        if d % 2:  # an item with words exchanged, left out and put in
            for w in items[rng.randrange(60)][1].split():
                words += [w] if rng.random() < 0.8 else []
                words += [word()] if rng.random() < 0.3 else []
        texts.append((d, " ".join(words)))
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    number = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    want = set()
    for d, text in texts:
        for k, item in items:
            n = len(item.split())
            if brute_score([number[w] for w in item.split()], [number[w] for w in text.split()]) >= max(n, 2 * min(D.N, n)):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()} == want and len(want) > 200


def test_fewest_words():
    """By all ways to put m matches in runs of fewer than N, with a loss between runs."""
    for least in range(2, 40):
        for words in range(1, 30):
            m = D.fewest_words(least, words)
            score = lambda m: 2 * m - (-(-m // 2) - 1)
            assert all(score(x) < least for x in range(1, min(m, words + 1))) and (m == words + 1 or score(m) >= least)


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    item = [f"w{k}" for k in range(30)]
    noise = lambda n: [f"n{rng.randrange(500)}" for _ in range(n)]
    edited = lambda step: [f"x{k}" if k % step == step - 1 else w for k, w in enumerate(item)]
    copies = {step: noise(40) + edited(step) + noise(40) for step in (3, 4, 5, 6)}
    copies[7] = noise(9) + [w for x in item for w in (x, "zz")] + noise(9)  # a word put in after each
    for others in ([], [item] * 50, [item[:15]] * 50, [item[15:]] * 50):  # verbatim copies, copies of a half
        texts = [*copies.values(), *(noise(5) + x + noise(5) for x in others), noise(200), rng.sample(item, 30)]
        number = {w: k for k, w in enumerate({w for t in (item, *texts) for w in t})}
        want = {d: brute_score([number[w] for w in item], [number[w] for w in t]) / 60 for d, t in enumerate(texts)}
        want = {d: s for d, s in want.items() if s >= D.MIN_SIMILARITY}
        assert set(range(5)) <= set(want)
        docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert {r.doc_id: r.similarity for r in D.leaks(docs, bench).collect()} == want
        assert {r.doc_id for r in D.decontaminated(docs, bench).collect()} == set(range(len(texts))) - set(want)


def test_bounds_miss_nothing():
    rng = random.Random(4)
    for _ in range(400):
        items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14)))) for k in range(4)]
        held = D.Items(items)
        ids = held.ids_of(" ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(40))))
        want = {}
        for k, item in enumerate(held.items):
            score = brute_score(item, ids)
            if score >= max(len(item), 2 * min(D.N, len(item))):
                want[k] = score / (2 * len(item))
        assert {i: s for i, s, *_ in held.leaks(ids)} == want
