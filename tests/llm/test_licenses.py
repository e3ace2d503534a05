import random
import re

from tesserae.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places = []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def longest_ending(words, templates):
    out = []
    for i in range(len(words)):
        best = 0
        for t in templates:
            for e in range(1, len(t) + 1):
                n = 0
                while n < e and n <= i and t[e - 1 - n] == words[i - n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(100):
        ts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        auto, text = L.Automaton(ts), [rng.randrange(1, 4) for _ in range(20)]
        state = size = 0
        got = []
        for w in text:
            while state and w not in auto.next[state]:
                state = auto.link[state]
                size = auto.length[state]
            if w in auto.next[state]:
                state, size = auto.next[state][w], size + 1
            got.append(size)
            for k, at in auto.ends[state]:
                assert size <= auto.length[state] and (state == 0 or ts[k][at - 1] == w)
        assert got == longest_ending(text, ts)


def test_places_and_labels(spark):
    rng = random.Random(2)
    pool = ["cc", "BY", "by", "all", "rights", "reserved", "general", "public", "license", "x", "é", "-", "this", "gnu", "cc-by"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "all rights reserved. " * 4000), (903, "a" + L.TEMPLATES["mit"]), (904, L.TEMPLATES["apache"].replace("compliance", "harmony")), (905, "Thé thatonre\x00and\x7fall rights\treserved"), (905, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as key", "1 as n_words")
    got = sorted((r.doc_id, r.n_words, sorted((p["first"], p["label"]) for p in r.places)) for r in L.scanned(df).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)
    assert L.scanned(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "x " + L.TEMPLATES["mit"]), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "All rights reserved. all rights reserved"), (5, "the and of to that is with free software")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op8_licenses(spark, str(tmp_path)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score > 0.9
    assert got[2].labels == "cc-by,cc-by-nc" and got[2].n_base == 1 and got[2].first_word == 2
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 3)
    assert got[5].labels == "" and got[5].score < 0.2
