import random

from tesserae.llm import lines as L


def brute(rows, window=L.WINDOW, long=L.LONG):
    """rows: (id, text) with distinct ids, in order of id."""
    seen, out = set(), {}
    parsed = {i: [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in rows}
    for i, t in rows:
        gone, ls = set(), parsed[i]
        for p in range(len(ls)):
            for n in (1, window):
                part = ls[p : p + n]
                if len(part) < n or n == 1 and len(part[0][1]) < long:
                    continue
                key = (n, *(x for _, x in part))
                if key in seen:
                    gone |= {k for k, _ in part}
                seen.add(key)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    pool = ["abc", " abc", "d e", "fgh", "", "  ", "ij", "klm", "n", "o\tp", "é" * 250, "q" * 199, "r" * 200 + " "]
    rows = [(i, "\n".join(rng.choice(pool + [str(rng.random())] * 12) for _ in range(rng.randrange(14)))) for i in range(120)]
    base = [str(rng.random()) for _ in range(30)]
    rows += [(200 + k, "\n".join(base[k % 5 : 20 + k])) for k in range(8)]
    return rows + [(300, None), (301, ""), (302, "x\n" * 400 + "y"), (303, "\n".join(base)), (304, "z" * 100_000)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L as n_chars", "'k' as key", "1 as at").repartition(5)
    got = L.deduplicated(df)
    assert got.columns == df.columns
    got = {r.doc_id: r for r in got.collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_repeated_rows_nulls_and_empty(spark):
    x = "a1\nb2\nc3\nd4"
    df = spark.createDataFrame([(1, x), (1, x), (None, "z\n" + x), (None, "z\n" + x)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.text) for r in L.deduplicated(df).collect()) == [(1, x), (1, x), (9, "z"), (9, "z")]
    assert L.deduplicated(df.limit(0)).count() == 0


def test_same_as_sql(spark, tmp_path):
    import duckdb

    rows = corpus(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, n_lines, n_removed, text from ({L.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in L.op2_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
