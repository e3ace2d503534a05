import random
import re

import pytest

from tesserae.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéÀZ.") for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    line = text(30)
    rows = []
    for _ in range(60):
        words = text(rng.choice([1, 2, 4, 5, 6, 20, 60, 200]))
        if rng.random() < 0.6:
            words += line
        rows.append(words)
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(copy) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            rows.append(copy)
    rng.shuffle(rows)
    out = [(i, rng.choice(["  ", "\n", " "]).join(w)) for i, w in enumerate(rows)]
    return out + [(9000, None), (9001, ""), (9002, " \t"), (9003, "w " * 40_000), (9004, "W x"), (9005, "w X")]


@pytest.mark.parametrize("seed,often,hubs", [(1, 20, True), (2, 4, True), (3, 1, False)])
def test_against_brute_force(spark, monkeypatch, seed, often, hubs):
    monkeypatch.setattr(J, "OFTEN", often)
    if not hubs:  # groups of one: the matrix alone finds all links
        monkeypatch.setattr(J, "_hubs", lambda rows: rows.selectExpr("doc_id", "doc_id hub").limit(0))
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as token")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.joined(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (4, "A b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.joined(df).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 0, 2), (4, 2, 1)]
    assert sorted(r.doc_id or 0 for r in J.one_of_each(df).collect()) == [0, 1, 1, 2]
    assert J.joined(df.limit(0)).count() == 0


def test_same_as_sql(spark, tmp_path):
    import duckdb

    rows = corpus(7)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, n_shingles, component_id from ({J.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in J.op5_jaccard(spark, str(tmp_path)).collect()) == sorted(want)


def test_one_id_with_two_texts(spark):
    rng = random.Random(1)
    a, b = ([rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "x"])), (4, None), (4, "four"), (None, " ".join(a)), (5, "")]
    got = sorted(map(tuple, J.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 0, 4), (4, 1, 4), (None, 56, None), (5, 0, 5)], key=str)


def test_small_relatives_of_large_documents_share_a_hub(spark):
    """The tokens' most central document is too large for 40 of the documents; they are one group all the same, and the matrix has no row for two of them."""
    rows = spark.createDataFrame([(t, d, n) for n, ids in ((146, range(30)), (59, range(100, 140))) for d in ids for t in range(10)], "token long, doc_id long, n long")
    hub = {r.doc_id: r.hub for r in J._hubs(rows).collect()}
    assert len({hub.get(d, d) for d in range(30)}) == len({hub.get(d, d) for d in range(100, 140)}) == 1
    homes = spark.createDataFrame([(d, n, hub.get(d, d)) for n, ids in ((146, range(30)), (59, range(100, 140))) for d in ids], "doc_id long, n long, hub long")
    assert J.guests(rows, homes).count() == 0
