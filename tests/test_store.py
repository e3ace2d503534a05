"""Writes of several tables, the star's plan, the bounded search and the session context against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae.operators import commits as K
from tesserae.operators import graph as G
from tesserae.operators import star as X
from tesserae.operators import summaries as Y

from .rows import joined_rows
from .test_queries import DIR


def test_the_star_is_joined_without_a_shuffle(spark):
    star = entry.queries()["projection_star"](spark, DIR)
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Broadcast" not in plan
    star.collect()
    assert "Exchange" not in star._jdf.queryExecution().executedPlan().toString()


def test_every_kind_of_outcome_occurs(spark):
    kinds = lambda name: {r.outcome for r in entry.queries()[name](spark, "/root/testdata/sf0.01").select("outcome").distinct().collect()}
    assert kinds("fact_outcomes") >= {"stored", "known", "forgotten", "blocked owner", "class", "class below its evidence", "authority without basis"}
    assert kinds("episode_outcomes") == {"created", "known", "overlaps", "unquoted"}


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_two_writers(spark, tmp_path):
    store = str(tmp_path / "store")
    assert K.head(spark, store) == 0
    assert K.commit(spark, store, 0, {"a": rows(spark, 1), "b": rows(spark, 10)}) == 1
    base = K.head(spark, store)
    assert K.commit(spark, store, base, {"a": rows(spark, 2)}) == 2  # the first writer
    with pytest.raises(K.Conflict):  # the second one began at the same version
        K.commit(spark, store, base, {"a": rows(spark, 3), "b": rows(spark, 30)})
    seen = lambda name, at=None: sorted(r.v for r in K.table(spark, store, name, at).collect())
    assert seen("a") == [1, 2] and seen("b") == [10] and seen("a", 1) == [1]
    K.commit(spark, store, 2, {"a": rows(spark, 9)}, replaced=("a",))
    assert seen("a") == [9] and seen("a", 2) == [1, 2]


def test_a_failed_check_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    K.commit(spark, store, 0, {"a": rows(spark, 1)})
    for bad in (rows(spark, 5, -5), rows(spark, 5, None)):
        with pytest.raises(K.Invalid):
            K.commit(spark, store, 1, {"b": rows(spark, 7), "a": bad}, {"a": F.col("v") > 0})
    assert K.head(spark, store) == 1
    with pytest.raises(K.Invalid):
        K.commit(spark, store, 1, {"a": spark.createDataFrame([("x",)], "v string")})
    with pytest.raises(KeyError):
        K.table(spark, store, "b")


def test_a_lost_writer(spark, tmp_path):
    store = tmp_path / "store"
    K.commit(spark, str(store), 0, {"a": rows(spark, 1)})
    (store / "commits" / f"{2:012d}.json").touch()
    assert K.head(spark, str(store)) == 1
    with pytest.raises(K.Conflict):
        K.commit(spark, str(store), 1, {"a": rows(spark, 2)})
    assert K.recovered(spark, str(store)) == 0 and K.recovered(spark, str(store), 0) == 1
    assert K.commit(spark, str(store), 1, {"a": rows(spark, 2)}) == 2


def test_storing_again_after_a_conflict(spark, tmp_path, monkeypatch):
    """Another writer stores the same fact between the reading and the commit: the retry knows it."""
    fields = "request_id long, owner string, content string, classification int, authority string, basis string, evidence_class int, user_evidence boolean"
    ask = lambda i, text: spark.createDataFrame([(i, "u", text, 1, "inference", "", 0, False)], fields)
    store, none = str(tmp_path / "store"), spark.createDataFrame([], "owner string, content string")
    plain, raced = K.commit, []

    def late(*args, **kwargs):
        if not raced:
            raced.append(True)
            K.store_facts(ask(1, " same "), store, none)
        return plain(*args, **kwargs)

    monkeypatch.setattr(K, "commit", late)
    got = K.store_facts(ask(2, "same").unionByName(ask(3, "other")), store, none)
    assert sorted((r.request_id, r.outcome) for r in got.collect()) == [(2, "known"), (3, "stored")]
    assert sorted(r.fact_id for r in K.table(spark, store, "facts").collect()) == [1, 3]
    assert K.table(spark, store, "documents").count() == 2


def plain_search(edges, seeds, hops, most_nodes, most_edges):
    """Edge by edge, as one would with a queue."""
    near = {}
    for e, a, b in sorted(edges):
        near.setdefault(a, []).append((e, b))
        near.setdefault(b, []).append((e, a))
    nodes = {n: anchored for n, anchored in seeds if n in near}
    frontier, visited = list(nodes.items()), []
    for hop in range(1, hops + 1):
        nxt = []
        for node, anchored in frontier:
            for e, to in near[node]:
                if len(visited) >= most_edges or len(nodes) >= most_nodes:
                    return visited
                if e in {v[0] for v in visited}:
                    continue
                visited.append((e, hop, anchored))
                if to not in nodes:
                    nodes[to] = anchored
                    nxt.append((to, anchored))
        frontier = nxt
    return visited


@pytest.mark.parametrize("hops,most_nodes,most_edges", [(1, 50, 50), (2, 9, 50), (3, 50, 12), (3, 14, 22), (3, 400, 400)])
def test_bounded_search_against_a_queue(spark, hops, most_nodes, most_edges):
    rng = random.Random(hops * most_nodes)
    edges = [(k, f"n{rng.randrange(30)}", f"n{min(rng.randrange(30), rng.randrange(30))}") for k in range(120)]
    seeds = {q: [(f"n{n}", k % 2 == 0) for k, n in enumerate(rng.sample(range(34), 3))] for q in range(8)}
    seeds[9] = [("nobody", True)]
    frame = spark.createDataFrame([(q, n, k, a) for q, ns in seeds.items() for k, (n, a) in enumerate(ns)], "query_id long, node string, place int, anchored boolean")
    got = {}
    visited, _ = G.budgeted(spark.createDataFrame(edges, "edge_id long, a string, b string"), frame, hops, most_nodes, most_edges)
    for r in visited.orderBy("hop", "place").collect():
        got.setdefault(r.query_id, []).append((r.edge_id, r.hop, r.anchored))
    for q, own in seeds.items():
        assert got.get(q, []) == plain_search(edges, own, hops, most_nodes, most_edges), q


def plain_context(items, budget):
    """As rounds: a pair, then a summary, until one does not fit or is not there."""
    size = {(k, n): z for k, n, z in items}
    there = lambda kind: sorted(n for k, n, _ in items if k == kind)
    pairs, daily, weekly, quarterly = map(there, ("pair", "daily", "weekly", "quarterly"))
    out = [("pair", n) for n in pairs[:8]]
    used = sum(size[x] for x in out) + max(len(out) - 1, 0)
    if daily:
        out.append(("daily", daily[0]))
        used += size[out[-1]]
    pairs, daily, turn, places = pairs[8:], daily[1:], 0, 0
    while used < budget and pairs:
        if used + size["pair", pairs[0]] > budget:
            break
        out.append(("pair", pairs.pop(0)))
        used += size[out[-1]]
        streams = [("daily", daily), ("weekly", weekly), ("quarterly", quarterly)]
        if turn % 3 == 2:
            places += 1
            streams = [("quarterly", quarterly)] * (places % 6 == 0) + [("weekly", weekly)] + streams
        found = next(((k, s) for k, s in streams if s), None)
        if found is None or used + size[found[0], found[1][0]] > budget:
            break
        out.append((found[0], found[1].pop(0)))
        used += size[out[-1]]
        turn += 1
    return out


def test_session_context_against_rounds(spark):
    rng = random.Random(6)
    cases = {k: [(kind, n, rng.randrange(1, 40)) for kind, most in (("pair", 60), ("daily", 14), ("weekly", 30), ("quarterly", 6)) for n in range(rng.choice([0, 1, most // 4, most]))] for k in range(40)}
    frame = spark.createDataFrame([(k, *i) for k, items in cases.items() for i in items], "session_id long, kind string, nr int, size int")
    for budget in (150, 700, 5000):
        got = {}
        for r in Y.session_context(frame, budget).orderBy("place").collect():
            got.setdefault(r.session_id, []).append((r.kind, r.nr))
        for k, items in cases.items():
            assert got.get(k, []) == plain_context(items, budget), (k, budget)
    assert Y.context_budget(128_000) == 6400 and Y.context_budget(2_000_000) == 50_000


def test_windows_that_retire_nothing(spark):
    from datetime import date

    d = lambda n: date(2024, 1, n)
    files = [
        (1, "u", d(1), d(3), 10, False),
        (2, "u", d(1), d(3), 20, False),  # equal and later: retires 1
        (3, "u", d(1), d(9), 5, False),  # contains all, but earlier
        (4, "u", d(1), d(9), 30, True),  # later, but with holes: retires nothing
        (5, "w", d(1), d(9), 40, False),  # another owner
        (6, None, d(1), d(9), 50, False),
        (7, "u", d(2), d(2), 20, False),  # written at once with 2 and larger: stays
        (8, "u", d(5), None, 60, False),
        (9, "u", d(6), d(6), 30, False),
        (10, "u", d(5), d(8), 31, None),  # unknown holes count as holes
        (11, "u", d(6), d(7), 32, False),  # retires 9
    ]
    frame = spark.createDataFrame(files, "file_id long, owner string, start_day date, end_day date, written long, holes boolean")
    assert sorted(r.file_id for r in Y.superseded(frame).collect()) == [1, 9]


def test_record_keys_of_nulls(spark):
    got = spark.createDataFrame([("o", 1), (None, 1), ("o", None)], "owner string, id long").select(X.record_key(F.lit("durable"), F.col("owner"), F.col("id")).alias("k")).collect()
    assert [r.k for r in got] == ["durable:o:1", None, None]


def test_reasons_to_withhold(spark):
    from tesserae.operators import publication as U

    kinds = {r.reason for r in entry.queries()["publication_recheck"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert kinds == {None, "stale-version", "unauthorized-source", "restricted-source", "superseded", "forgotten", "source-withheld"}
    items = [(1, 1, "u", "durable", 1, "r1", [5]), (1, 2, "u", "durable", 1, None, None), (1, 3, "u", "durable", 2, "r1", []), (1, 4, "u", "durable", 3, "r1", [6]), (1, 5, None, "durable", 1, "r1", None), (1, 6, "u", "durable", None, "r1", None)]
    current = [("durable", 1, "u", "r1", 1, None, None), ("durable", 2, "u", "r1", None, False, False), ("durable", 3, "u", "r1", 0, False, False)]
    got = U.rechecked(
        spark.createDataFrame(items, "query_id long, item_id long, principal string, layer string, record_id long, version string, refs array<long>"),
        spark.createDataFrame(current, "layer string, record_id long, owner string, version string, classification int, encrypted boolean, replaced boolean"),
        spark.createDataFrame([(5, "u"), (6, None)], "id long, owner string"),
        spark.createDataFrame([], "layer string, record_id long"),
    )
    assert {r.item_id: r.reason for r in got.collect()} == {1: None, 2: "stale-version", 3: "restricted-source", 4: "source-withheld", 5: "unauthorized-source", 6: "stale-version"}


def test_a_search_at_hubs_joins_what_it_may_visit_only(spark):
    """300 queries at hubs of 300 edges each: every node's first edges are enough."""
    edges = spark.range(1200).selectExpr("id AS edge_id", "concat('s', id div 4) AS a", "concat('t', id % 4) AS b")
    seeds = spark.range(300).selectExpr("id AS query_id", "concat('t', id % 4) AS node", "0 AS place", "true AS anchored")
    found = []
    assert joined_rows(spark, lambda: found.append(G.budgeted(edges, seeds, 2, 30, 20)[0].count())) <= 300 * 60
    assert found == [300 * 20]
