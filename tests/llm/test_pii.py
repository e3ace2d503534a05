import hashlib
import random
import re

from tesserae.llm import pii as P

#: The base expressions as given, matched by Python.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(ds):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(ds)))) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PLAIN.items():
        spans = []
        for m in re.finditer(pattern, text or ""):
            ds = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(ds) <= 19 and luhn(ds), "phone": lambda: 9 <= len(ds) <= 15}[kind]()
            if ok:
                spans.append((m.start(), m.end()))
        out[kind] = spans
    return out


def texts():
    rng = random.Random(3)
    yield from (None, "", "a@b.c", "a@b.com_x@y.org", "x@y", "@a.b a@.b a@b..c a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (743) 555-3824) +12", "é😀 a@b.cd 😀 +49 30 123456789", "9" * 40_000, "1 " * 20_000, "a" * 200_000, "a.b-" * 30_000, "a@" * 20_000, "+1" * 9000, "1.2.3.4 " * 6000)
    for _ in range(1500):
        yield "".join(rng.choice("0123456789" * 2 + "  .-+@@()ab%_é\n") for _ in range(rng.randrange(120)))


def test_base_kinds(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as email", "'x' as text_key")
    got = {r.doc_id: r for r in P.found_spans(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        for kind, spans in brute(t).items():
            assert [(s["start"], s["end"]) for s in got[i][kind]] == spans, (i, kind, (t or "")[:80])
    assert P.found_spans(df.limit(0)).count() == 0


def test_bootstrapping(spark):
    rows = [(i, f'abc token = "{hashlib.md5(str(i).encode()).hexdigest()}" def') for i in range(10)]
    rows += [(100, 'x token = "short9code" y'), (101, 'level = "grade7school" y'), (102, "see chapter: 12345678a"), (None, 'token = "short9code"'), (None, 'token = "short9code"')]
    rows += [(103, 'token = "a1@example.com" b')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, [(s["start"], s["end"]) for s in r.secret]) for r in P.found_spans(df).collect()]
    assert (100, [(11, 21)]) in got and got.count((None, [(9, 19)])) == 2
    assert (101, []) in got and (102, []) in got and (103, []) in got
    assert all(s for i, s in got if i is not None and i < 10)


def test_query(spark, tmp_path):
    rows = [(1, "a@b.cd +1 (743) 555-3824"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op4_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,phone:7:24" and got[1].n_email == got[1].n_phone == 1 and got[1].n_card == 0
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,phone:7:24").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_long_values_and_keys(spark):
    key = "a_rather_long_name_of_a_secret_key"
    rows = [(i, f'{k} = "{hashlib.md5(f"{k}{i}".encode()).hexdigest()}" def') for k, at in (("token", 0), (key, 20)) for i in range(at, at + 10)]
    signed, late = "eyJ0" + "aB-_x9." * 45, "x" * 80 + "7"
    rows += [(100, f'token = "{signed}" end'), (101, f'token = "{late}" end'), (102, f'{key} = "short9code" end'), (103, "k" * 200_000 + '="' + "v" * 200_000 + '1 token="' + "9w" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.secret] for r in P.found_spans(df).collect()}
    assert got[100] == [(9, 9 + len(signed))] and got[101] == [(9, 90)]
    assert got[102] == [(len(key) + 4, len(key) + 14)] and got[103] == [(400_011, 600_011)]


def scored(edges):
    """The graph's scores, in plain Python: edges are (pattern, value, n, seed, other)."""
    def confidences(belief):
        total, good, support = {}, {}, {}
        for p, v, n, seed, _ in edges:
            total[p] = total.get(p, 0) + n
            good[p] = good.get(p, 0) + n * belief[v]
            support[p] = support.get(p, 0) + seed
        return {p: (good[p] / total[p], support[p]) for p in total}

    seeds = {v: max(e[3] for e in edges if e[1] == v) for v in {e[1] for e in edges}}
    belief = dict(seeds)
    for _ in range(P.ROUNDS):
        sure = confidences(belief)
        for v in belief:
            doubt, other = 1.0, False
            for p, w, _, _, o in edges:
                if w == v:
                    held = " " not in p or sure[p][0] >= P.TELLING and sure[p][1] >= P.MIN_SUPPORT
                    doubt, other = doubt * (1 - 0.9 * sure[p][0] * held), other or o
            belief[v] = max(seeds[v], 0.0 if other else 1 - doubt)
    return confidences(belief)


def test_scores(spark):
    rng = random.Random(8)
    values = {f"v{i}": (rng.random() < 0.5, rng.random() < 0.2) for i in range(30)}
    rows = [(f"p{rng.randrange(4)}" + " _" * rng.randrange(2), v, *values[v]) for v in rng.choices(list(values), k=200)]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    want = scored([(p, v, n, int(s), o and not s) for (p, v, s, o), n in counts.items()])
    df = spark.createDataFrame([(p, v, s, o and not s) for p, v, s, o in rows], "pattern string, value string, seed boolean, other boolean")
    got = {r.pattern: (r.confidence, r.support) for r in P.scored_patterns(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)


def test_recall_of_unseen_shapes(spark):
    """Secrets that no seed looks like, in contexts of each sort; clean values in prose stay."""
    rng = random.Random(4)
    prose = ["of", "the", "river", "stone", "walks", "under", "green", "light", "seven", "birds"]
    contexts = ['token = "{}"', "api_key: {}", "my password is {} ok", "see {} as credential here"]

    def shape(hexes):
        if hexes:
            return hashlib.md5(str(rng.random()).encode()).hexdigest()
        return "".join(rng.choice("ghjkmnpqrstuvwxyzGHJKMN") for _ in range(7)) + str(rng.randrange(10, 99)) + rng.choice("wxyz")

    rows, secret, clean = [], {}, set()
    for i in range(400):
        words = rng.choices(prose, k=20)
        if i % 4 < 2:
            value = shape(i % 4 == 0)
            words.insert(10, rng.choice(contexts).format(value))
            text = " ".join(words)
            secret[i] = ((text.index(value), text.index(value) + len(value)), i % 4)
        else:
            words.insert(10, "chapter" + str(rng.randrange(100, 999)) if i % 4 == 2 else f"ann{i}@example.com")
            text = " ".join(words)
            clean.add(i)
        rows.append((i, text))
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.secret] for r in P.found_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unseen = [i for i, (_, k) in secret.items() if k == 1]
    assert sum(secret[i][0] in got[i] for i in unseen) >= 0.9 * len(unseen)
    assert not any(got[i] for i in clean)
