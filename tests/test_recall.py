"""The lexical stage and the index against plain versions of them."""

import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from tesserae.functions.stem import stem
from tesserae.operators import retrieval as R
from tesserae.plans import probes, recall
from tesserae.sources import index as I

DOCS = "doc_id long, version string, text string, lang string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bare(w):
    return "".join(c for c in unicodedata.normalize("NFD", w) if not "̀" <= c <= "ͯ")


def weight(tf, size, avg):
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))


def best(scores, most):
    return [d for d, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:most]]


def any_of(docs, stems, cap):
    bags = {d: [stem(w) for w in words(t)] for d, (t, _) in docs.items()}
    avg = sum(map(len, bags.values())) / len(bags)
    scores = {}
    for s in set(stems):
        df = sum(s in b for b in bags.values())
        for d, b in bags.items():
            if s in b:
                scores[d] = scores.get(d, 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * weight(b.count(s), len(b), avg)
    return best(scores, cap)


def phrase(docs, stems, cap):
    bags = {d: [stem(w) for w in words(t)] for d, (t, _) in docs.items()}
    avg = sum(map(len, bags.values())) / len(bags)
    n = len(stems)
    counts = {d: sum(b[i : i + n] == stems for i in range(len(b))) for d, b in bags.items()} if n else {}
    return best({d: weight(k, len(bags[d]), avg) for d, k in counts.items() if k}, cap)


def substrings(docs, term, english):
    own = {d: t or "" for d, (t, lang) in docs.items() if not english or lang == "en"}
    avg = sum(len(t) - 2 for t in own.values()) / len(own)
    n = len(term)
    every = [term] + ([term[:-1], term[1:], term[:-2], term[1:-1], term[2:], term[:-3]] if n > 6 else [])
    for v in every:
        counts = {d: sum(bare(w)[i : i + len(v)] == v for w in words(t) for i in range(len(bare(w)))) for d, t in own.items()}
        if any(counts.values()):
            return best({d: weight(k, len(own[d]) - 2, avg) for d, k in counts.items() if k}, 12)
    return []


def plain_ranks(docs, text, context, cap):
    terms = list(dict.fromkeys(w for w in words(text) if len(w) > 2))[:8]
    asked = [("porter", phrase(docs, [stem(w) for w in words(text[:512])], cap), cap), ("porter", any_of(docs, [stem(w) for w in terms], cap), cap)]
    for field, english in (("trigram_en", True), ("trigram_orig", False)):
        asked += [(field, substrings(docs, bare(t), english), 12) for t in terms if len(bare(t)) >= 3]
    asked.append(("context", any_of(docs, [stem(w) for w in dict.fromkeys(w for w in words(context) if len(w) > 2)], cap), cap))
    taken, ranks, held = 0, {}, set()
    for field, rows, most in asked:
        start = taken
        if start >= cap:
            continue
        for d in rows[: min(most, cap - start) if most < cap else most]:
            if (d, field) in ranks or d not in held and taken >= cap:
                continue
            held.add(d)
            ranks[d, field] = taken
            taken += 1
    return ranks


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    pool = ["running", "runs", "generation", "generalize", "Müller", "cafés", "the", "of", "recollection", "collecting", "anagrams", "banana", "x1", "alpha", "beta", "gamma", "übergeneralisierung"]
    docs = {i: (" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de"])) for i in range(60)}
    docs[60], docs[61] = (None, "en"), ("", "de")
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame([(i, "1", t, lang) for i, (t, lang) in docs.items()], DOCS)
    I.publish(df, path, 3)
    return docs, df, path


def test_lexical_ranks_against_a_plain_version(spark, corpus):
    docs, _, path = corpus
    texts = {1: ("the generation of alpha", "gamma beta"), 2: ("recollections übergeneralisierungen", "running"), 3: ("Running THE Müller", "x1 the"), 4: ("nothing herein", ""), 5: ("banana", "banana"), 6: ("an", "of")}
    q = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "query_id long, text string")
    c = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()], "query_id long, text string")
    for cap in (9, 24):
        got = {}
        for r in probes.Lexical(spark, path).ranks(q, c, cap).collect():
            got.setdefault(r.query_id, {})[r.doc_id, r.field] = r["rank"]
        for k, (t, around) in texts.items():
            assert got.get(k, {}) == plain_ranks(docs, t, around, cap), (k, cap)


def test_slots_past_the_cap(spark):
    rows = [(1, 0, p, 3, "porter", d) for p, d in enumerate([7, 8])] + [(1, 1, p, 12, "trigram_en", d) for p, d in enumerate([8, 9, 10])] + [(1, 2, 0, 3, "context", 7)]
    got = probes.slots(spark.createDataFrame(rows, "query_id long, probe int, place int, most int, field string, doc_id long"), 3).collect()
    # two slots are taken by 7 and 8, the trigram probe may give one row: 8 again, in its field; then all slots are taken
    assert sorted((r["rank"], r.doc_id, r.field) for r in got) == [(0, 7, "porter"), (1, 8, "porter"), (2, 8, "trigram_en")]


def test_read_path_end_to_end(spark, corpus):
    docs, df, path = corpus
    texts = {1: ("the generation of alpha", "gamma beta"), 3: ("Running THE Müller", "x1 the")}
    q = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "query_id long, text string")
    c = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()], "query_id long, text string")
    got = {}
    for r in sorted(recall.recalled(df.select("doc_id", "text"), q, path, "fast", c).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.doc_id)
    for k, (text, around) in texts.items():
        cands = {}
        for (d, field), rank in plain_ranks(docs, text, around, 24).items():
            row = cands.setdefault(d, [0.0, set()])
            row[0] += 60 / (60 + rank) * (0.5 if field == "context" else 1)
            row[1].add(field)
        terms = [w for w in dict.fromkeys(words(text)) if len(w) > 2]
        rows = []
        for d, (score, fields) in cands.items():
            cover = sum(any(w.startswith(t) for w in words(docs[d][0])) for t in terms) / len(terms)
            if cover == 0 and "context" not in fields:
                continue
            if cover == 1:
                score = max(score, 1.2 if fields - {"context"} else 0.6)
            rows.append((2 if cover == 1 else 1 if cover else 0, max(score, 0.01), d))
        want = []
        for tier in (2, 1, 0):
            own = sorted((r for r in rows if r[0] == tier), key=lambda r: (-r[1], r[2]))
            want += [own[i][2] for i in R.mmr_order([docs[r[2]][0] for r in own], [r[1] for r in own])]
        assert got[k] == want[: R.PROFILES["fast"]["items"]]
        held = [r.doc_id for r in recall.recalled(df.select("doc_id", "text"), q.where(f"query_id = {k}"), path, "fast", c, required=spark.createDataFrame([(k, want[-1])], "query_id long, doc_id long")).collect()]
        assert want[-1] in held and len(held) == len(got[k])


def test_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    base = spark.createDataFrame([(1, "1", "a b a", "en"), (2, "1", "b", "en"), (3, "1", "c", "de")], DOCS)
    I.publish(base, path, 2)
    assert I.applied(base, path) == {} and I.segments(spark, path) == [0]
    later = spark.createDataFrame([(1, "2", "z", "en"), (2, "1", "b", "en"), (4, "1", None, "en")], DOCS)
    assert I.applied(later, path) == {"missing": 1, "stale": 1, "orphaned": 1}
    rows = lambda p: sorted((r.term, r.doc_id, r.tf, r.spots) for r in I.postings(spark, p).collect())
    assert rows(path) == [("b", 2, 1, [0]), ("z", 1, 1, [0])]
    assert I.applied(base, path) == {"missing": 1, "stale": 1, "orphaned": 1}  # 3 comes back, 1 is edited, 4 goes
    assert rows(path) == [("a", 1, 2, [0, 2]), ("b", 1, 1, [1]), ("b", 2, 1, [0]), ("c", 3, 1, [0])]
    I.compacted(spark, path, str(tmp_path / "new"), 2)
    assert rows(str(tmp_path / "new")) == rows(path) and I.segments(spark, str(tmp_path / "new")) == [0]
    asked = spark.createDataFrame([("a",)], "term string")
    assert [r.doc_id for r in I.postings(spark, path, asked).collect()] == [1]


def test_a_segment_that_was_not_listed_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "1", "a", "en")], DOCS)
    I.publish(docs, path, 2)
    docs.select("doc_id", "version").write.parquet(f"{path}/segment=1/documents")
    assert I.segments(spark, path) == [0] and I.live(spark, path).count() == 1


def test_postings_are_made_where_the_text_is(spark, tmp_path):
    docs = spark.createDataFrame([(1, "1", "a b a", "en"), (1, "1", "b c", "en"), (2, "1", None, "en"), (3, "1", "z " * 5000, "en")], DOCS)
    plan = I.postings_of(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(term" not in plan
    I.publish(docs, str(tmp_path / "index"), 2)
    got = sorted((r.term, r.doc_id, r.tf, r.spots[:3]) for r in I.postings(spark, str(tmp_path / "index")).collect())
    assert got == [("a", 1, 2, [0, 2]), ("b", 1, 2, [0, 1]), ("c", 1, 1, [1]), ("z", 3, 5000, [0, 1, 2])]


def test_best_scores_are_those_of_all_scores(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 5)))) for i in rng.sample(range(5000), 1500)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "zz"), (4, "g"), (4, "f"), (4, "zz")], "query_id long, term string")
    index, stats = R.postings(docs, asked=asked).persist(), R.index_stats(docs)
    every, few = {}, {}
    for r in R.bm25(index, asked, stats).collect():
        every.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    for r in R.best_bm25(index, asked, stats, 5, lowest=True).collect():
        few.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    assert set(every) == set(few) == {1, 2, 4}
    for q in every:
        assert sorted(few[q])[:5] == sorted(every[q])[:5] and set(few[q]) <= set(every[q])
        assert sorted(d for _, d in few[q])[:5] == sorted(d for _, d in every[q])[:5]
    assert len(few[2]) < len(every[2])


def test_variants_are_found_without_ranking(spark, corpus, monkeypatch):
    monkeypatch.setattr(probes.Lexical, "substrings", None)
    docs, _, path = corpus
    asked = ["generali", "generalx", "ler", "ecol", "the", "qqq"]
    got = {r.variant for r in probes.Lexical(spark, path).found(spark.createDataFrame([(v,) for v in asked], "variant string")).collect()}
    assert got == {v for v in asked if any(v in bare(w) for t, _ in docs.values() for w in words(t))}


def test_best_rows_of_a_task():
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.choice([0.1, 0.2, 0.2 + 1e-8, 0.3, 0.4]), doc) for doc in rng.sample(range(1000), 300)] + [(9, 1.0, 7)]
    kept = [rows[i] for i in probes.best_rows(*map(np.array, zip(*rows)), 5).tolist()]
    for g in {r[0] for r in rows}:
        first = lambda some: sorted((-round(s, 6), d) for h, s, d in some if h == g)[:5]  # noqa: E731, B023
        assert first(kept) == first(rows)
    assert len(kept) < 60


def test_only_the_best_documents_of_a_variant_leave_a_task(monkeypatch):
    """All documents contain all variants; few are held, scored and remembered at once."""
    for name, value in (("CELLS", 200), ("HELD", 10), ("WORDS", 3)):
        monkeypatch.setattr(probes, name, value)
    rng = random.Random(6)
    docs = [(d, rng.randrange(20, 400), rng.random() < 0.5, [("bananas", rng.randrange(1, 4)), (f"ána{k}", 1), ("of", 2)]) for k, d in enumerate(rng.sample(range(10_000), 600))]
    kind = pa.schema([("doc_id", pa.int64()), ("letters", pa.int64()), ("english", pa.bool_()), ("packs", pa.list_(pa.struct([("words", pa.string()), ("tf", pa.binary())])))])
    rows = [(d, t, n) for d, *_, words in docs for t, n in words]
    postings = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rng.sample(rows, len(rows)))], names=["doc_id", "term", "tf"])
    packs = {}
    for at in range(0, len(rows), 50):
        for b in probes._packed(iter([postings.slice(at, 50)])):
            for r in b.to_pylist():
                packs.setdefault(r["doc_id"], []).append({"words": r["words"], "tf": r["tf"]})
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, (*r[:3], packs[r[0]]))) for r in docs[at : at + 100]], schema=kind) for at in range(0, 600, 100)]
    variants = ["ana", "banana", "nas", "xyz"]
    out = [r for b in probes._containing(variants, [200.0, 150.0], 12)(iter(batches)) for r in b.to_pylist()]
    assert len(out) < 2 * 3 * 20
    for english, average in ((False, 200.0), (True, 150.0)):
        for v in variants:
            tf = lambda words: sum(n * sum(bare(t).startswith(v, i) for i in range(len(t))) for t, n in words)  # noqa: E731, B023
            scores = {d: weight(tf(words), letters - 2, average) for d, letters, en, words in docs if tf(words) and (en or not english)}
            own = {r["doc_id"]: r["score"] for r in out if r["variant"] == v and r["english"] == english}
            assert best(own, 12) == best(scores, 12)


def test_phrases_are_found_where_a_document_is():
    kind = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("terms", pa.list_(pa.string())), ("spots", pa.list_(pa.list_(pa.int32())))])
    texts = {3: "a b a b c", 5: "b a", 8: "c c a b a", 9: ""}
    rows = []
    for d, text in texts.items():
        own = text.split()
        rows.append({"doc_id": d, "size": len(own), "terms": sorted(set(own)), "spots": [[i for i, w in enumerate(own) if w == t] for t in sorted(set(own))]})
    batch = pa.RecordBatch.from_pylist(rows, schema=kind)
    asked = [(1, "b", ["a", "b"]), (2, "c", ["c", "c"]), (3, "c", ["c"]), (4, "b", ["a", "b", "a"]), (5, "c", ["c", "z"])]
    got = {(r["query_id"], r["doc_id"], r["size"], r["tf"]) for out in (batch, batch.slice(1)) for b in probes._phrases(asked)(iter([out])) for r in b.to_pylist()}
    assert got == {(1, 3, 5, 2), (1, 8, 5, 1), (2, 8, 5, 1), (3, 3, 5, 1), (3, 8, 5, 2), (4, 3, 5, 1), (4, 8, 5, 1)}
