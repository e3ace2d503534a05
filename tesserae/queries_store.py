"""Queries of the operators that write, join the projection star, search the graph in bounds and sweep summaries; with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import commits as K
from .operators import graph as G
from .operators import publication as U
from .operators import star as X
from .operators import summaries as Y
from .queries import query
from .shared import new_folder
from .sources.tables import MESSAGES_SQL, messages, table

# -- the projection star ---------------------------------------------------------
STAR_SQL = """dc AS (SELECT doc_id, coalesce(source, '') AS owner, CASE WHEN doc_id % 3 = 0 THEN 'episode' ELSE 'durable' END AS layer, text, lang, n_chars FROM documents),
du AS (SELECT doc_id, lang AS memory_type, n_chars AS created_at FROM dc WHERE layer = 'durable' AND doc_id % 17 <> 0), ep AS (SELECT doc_id, 'about ' || lang AS topic, (n_chars % 100) / 100.0::DOUBLE AS prominence, n_chars AS start_ts FROM dc WHERE layer = 'episode' AND doc_id % 19 <> 0),
ve AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 5 = 0 THEN 'r0' ELSE 'r1' END AS version, embedding[1]::DOUBLE AS x FROM embeddings)"""


def _star(s, d):
    """The bucketed tables: written once for a session and folder."""
    made = s.sparkContext.__dict__.setdefault("_tesserae_stars", {})
    if d not in made or not s.catalog.tableExists(f"{made[d]}_documents"):
        i = F.col("doc_id")
        docs = table(s, d, "documents").withColumns({"owner": F.coalesce("source", F.lit("")), "layer": F.when(i % 3 == 0, "episode").otherwise("durable")})
        docs = docs.withColumns({"key": X.record_key(F.col("layer"), F.col("owner"), i), "version": F.lit("r1")})
        facts = docs.where("layer = 'durable' AND doc_id % 17 <> 0").select("key", F.col("lang").alias("memory_type"), F.col("n_chars").alias("created_at"), F.col("text").alias("content"))
        episodes = docs.where("layer = 'episode' AND doc_id % 19 <> 0").select("key", F.concat(F.lit("about "), "lang").alias("topic"), (F.col("n_chars") % 100 / 100.0).alias("prominence"), F.col("n_chars").alias("start_ts"))
        vectors = docs.select("key", F.col("doc_id").alias("vec_id")).join(table(s, d, "embeddings"), "vec_id").select("key", F.when(F.col("vec_id") % 5 == 0, "r0").otherwise("r1").alias("version"), F.col("embedding").alias("vector"))
        made[d] = X.saved({"documents": docs.select("key", "doc_id", "layer", "owner", "version"), "durables": facts, "episodes": episodes, "vectors": vectors})
    return made[d]


@query(f"""WITH {STAR_SQL} SELECT dc.doc_id, layer, memory_type, created_at, topic, prominence, start_ts, CASE WHEN ve.version = 'r1' THEN round(x, 6) END AS x
FROM dc LEFT JOIN du USING (doc_id) LEFT JOIN ep USING (doc_id) LEFT JOIN ve USING (doc_id)""")
def projection_star(s, d):
    return X.joined(s, _star(s, d)).select("doc_id", "layer", "memory_type", "created_at", "topic", "prominence", "start_ts", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"))


@query(f"""WITH {STAR_SQL} SELECT dc.doc_id FROM dc LEFT JOIN du USING (doc_id) LEFT JOIN ep USING (doc_id)
WHERE (layer = 'episode' OR memory_type = 'en') AND CASE WHEN layer = 'durable' THEN created_at ELSE start_ts END BETWEEN 200 AND 2000""")
def narrowed_star(s, d):
    return X.narrowed(X.joined(s, _star(s, d)), "en", 200, 2000).select("doc_id")


@query("""SELECT 'durable:' || source || ':' || doc_id AS key, 'r' || (1 + doc_id % 3) AS version, n_chars, len(list_distinct([doc_id // 2, doc_id // 3])) AS refs FROM documents
WHERE doc_id % 7 <> 0 AND doc_id % 4 <= 2 AND doc_id % 5 <> 0 AND source IS NOT NULL""")
def durable_documents(s, d):
    i = F.col("doc_id")
    facts = table(s, d, "documents").select(
        F.col("source").alias("owner"), i.alias("id"), (1 + i % 3).alias("revision"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_original"), F.lit("general").alias("scope"), F.lit("inference").alias("authority"),
        (i % 4).cast("int").alias("classification"), F.array(F.floor(i / 2), F.floor(i / 3)).alias("evidence"), F.when(i % 7 == 0, i).alias("superseded_by"), (i % 5 == 0).alias("encrypted"), "n_chars")
    out = X.durable_documents(facts).where("key IS NOT NULL")
    sizes = table(s, d, "documents").select(F.col("doc_id").alias("record_id"), "n_chars")
    return out.join(sizes, "record_id").select("key", "version", "n_chars", F.size("source_refs").alias("refs"))


# -- bounded graph search --------------------------------------------------------
def _hop_sql(h: int, nodes: int, edges: int) -> str:
    return f"""x{h} AS (SELECT f.query_id, f.place AS spot, b.edge_id, b.b, f.anchored FROM f{h - 1} f JOIN bo b ON b.a = f.node WHERE NOT EXISTS (SELECT 1 FROM v{h - 1} v WHERE v.query_id = f.query_id AND v.edge_id = b.edge_id)),
y{h} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, edge_id) - 1 AS i, (NOT EXISTS (SELECT 1 FROM n{h - 1} n WHERE n.query_id = x.query_id AND n.node = x.b) AND row_number() OVER (PARTITION BY query_id, b ORDER BY spot, edge_id) = 1) AS new
FROM (SELECT * FROM x{h} QUALIFY row_number() OVER (PARTITION BY query_id, edge_id ORDER BY spot) = 1) x),
z{h} AS (SELECT y.*, coalesce(sum(new::INT) OVER (PARTITION BY query_id ORDER BY spot, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found,
(SELECT count(*) FROM n{h - 1} n WHERE n.query_id = y.query_id) AS n0, (SELECT count(*) FROM v{h - 1} v WHERE v.query_id = y.query_id) AS e0 FROM y{h} y),
d{h} AS (SELECT * FROM z{h} WHERE e0 + i < {edges} AND n0 + found < {nodes}),
v{h} AS (SELECT * FROM v{h - 1} UNION ALL SELECT query_id, edge_id, {h} AS hop, i AS place, anchored FROM d{h}), f{h} AS (SELECT query_id, b AS node, i AS place, anchored FROM d{h} WHERE new),
n{h} AS (SELECT query_id, node FROM n{h - 1} UNION ALL SELECT query_id, node FROM f{h})"""


SEARCH_SQL = f"""ed AS (SELECT DISTINCT l_suppkey * 1000 + l_partkey % 40 AS edge_id, 's' || l_suppkey AS a, 't' || (l_partkey % 40) AS b FROM lineitem), bo AS (SELECT edge_id, a, b FROM ed UNION ALL SELECT edge_id, b, a FROM ed),
f0 AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS node, 0 AS place, true AS anchored FROM supplier WHERE 's' || s_suppkey IN (SELECT a FROM ed) UNION ALL SELECT s_suppkey, 't' || (s_suppkey % 40), 1, false FROM supplier WHERE 't' || (s_suppkey % 40) IN (SELECT b FROM ed)),
n0 AS (SELECT query_id, node FROM f0), v0 AS (SELECT query_id, 0::BIGINT AS edge_id, 0 AS hop, 0::BIGINT AS place, true AS anchored FROM f0 LIMIT 0), {_hop_sql(1, 30, 60)}, {_hop_sql(2, 30, 60)}"""


def _search(s, d):
    line = table(s, d, "lineitem")
    edge = F.col("l_suppkey") * 1000 + F.col("l_partkey") % 40
    edges = line.select(edge.alias("edge_id"), F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("t"), F.col("l_partkey") % 40).alias("b")).distinct()
    asked = table(s, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    own = asked.select("query_id", F.concat(F.lit("s"), "query_id").alias("node"), F.lit(0).alias("place"), F.lit(True).alias("anchored"))
    side = asked.select("query_id", F.concat(F.lit("t"), F.col("query_id") % 40).alias("node"), F.lit(1).alias("place"), F.lit(False).alias("anchored"))
    return edges, G.budgeted(edges, own.unionAll(side), 2, 30, 60)[0]


@query(f"WITH {SEARCH_SQL} SELECT query_id, edge_id, hop, anchored FROM v2")
def budgeted_graph_search(s, d):
    """Every supplier asks: two hops, 30 nodes and 60 edges at most."""
    return _search(s, d)[1].select("query_id", "edge_id", "hop", "anchored")


@query(f"""WITH {SEARCH_SQL} SELECT query_id, edge_id, doc_id, hop, anchored, row_number() OVER (PARTITION BY query_id ORDER BY hop, place) - 1 AS rank
FROM v2 JOIN documents ON doc_id = edge_id % 1000 * 3 WHERE edge_id % 5 <> 0 QUALIFY rank < 20""")
def graph_edge_hits(s, d):
    """Visited edges whose source is a document of the version that the edge was read from."""
    edges, visited = _search(s, d)
    sourced = edges.withColumns({"src_id": F.col("edge_id") % 1000 * 3, "src_version": F.when(F.col("edge_id") % 5 == 0, "0").otherwise("1")})
    return G.edge_hits(visited, sourced, table(s, d, "documents").select("doc_id", F.lit("1").alias("version")), 20)


# -- commits ---------------------------------------------------------------------
FACTS_SQL = """i AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 20 = 0 THEN 'system' ELSE source END AS owner, trim(text) AS content, doc_id % 4 AS classification, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'inference' END AS authority,
CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'said so' END AS basis, doc_id // 4 % 2 AS evidence_class, doc_id % 5 <> 0 AS user_evidence FROM documents),
p AS (SELECT *, CASE WHEN coalesce(trim(owner), '') = '' THEN 'no owner' WHEN owner IN ('system', 'agent', 'unknown') THEN 'blocked owner' WHEN coalesce(content, '') = '' THEN 'no content' WHEN classification NOT BETWEEN 0 AND 2 THEN 'class'
WHEN classification < evidence_class THEN 'class below its evidence' WHEN authority = 'user' AND (NOT user_evidence OR trim(basis) = '') THEN 'authority without basis' END AS problem FROM i),
g AS (SELECT DISTINCT source AS owner, trim(text) AS content, true AS gone FROM documents WHERE doc_id % 25 = 3),
ok AS (SELECT p.* FROM p LEFT JOIN g USING (owner, content) WHERE problem IS NULL AND gone IS NULL),
b1 AS (SELECT min(request_id) AS fact_id, owner, content FROM ok WHERE request_id % 2 = 1 GROUP BY owner, content),
b2 AS (SELECT min(request_id) AS fact_id, owner, content FROM ok WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.owner = ok.owner AND b1.content = ok.content) GROUP BY owner, content)"""


def _requests(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select(
        i.alias("request_id"), F.when(i % 20 == 0, "system").otherwise(F.col("source")).alias("owner"), F.col("text").alias("content"), (i % 4).cast("int").alias("classification"), F.when(i % 3 == 0, "user").otherwise("inference").alias("authority"),
        F.when(i % 6 == 0, "").otherwise("said so").alias("basis"), (F.floor(i / 4) % 2).alias("evidence_class"), (i % 5 != 0).alias("user_evidence"))


def _forgotten(s, d):
    return table(s, d, "documents").where("doc_id % 25 = 3").select(F.col("source").alias("owner"), F.col("text").alias("content"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, f.owner, length(content) AS size, 'durable:' || f.owner || ':' || fact_id AS key FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) f")
def stored_facts(s, d):
    """Two commits: the odd requests, then all; a fact and its search document come together."""
    store, asked = new_folder(s, "store"), _requests(s, d)
    for part in (asked.where("request_id % 2 = 1"), asked):
        K.store_facts(part, store, _forgotten(s, d))
    found = K.table(s, store, "documents").select("key", "size")
    return K.table(s, store, "facts").withColumn("key", F.concat_ws(":", F.lit("durable"), "owner", "fact_id")).join(found, "key").select("fact_id", "owner", "size", "key")


@query(f"""WITH {FACTS_SQL} SELECT request_id, CASE WHEN problem IS NOT NULL THEN problem WHEN gone THEN 'forgotten' WHEN b1.fact_id IS NOT NULL THEN 'known' WHEN b2.fact_id = request_id THEN 'stored' ELSE 'repeated' END AS outcome
FROM p LEFT JOIN g USING (owner, content) LEFT JOIN b1 USING (owner, content) LEFT JOIN b2 USING (owner, content)""")
def fact_outcomes(s, d):
    """What becomes of every request when the odd ones were stored before."""
    store, asked = new_folder(s, "store"), _requests(s, d)
    K.store_facts(asked.where("request_id % 2 = 1"), store, _forgotten(s, d))
    return K.store_facts(asked, store, _forgotten(s, d)).select("request_id", "outcome")


EPISODES_SQL = f"""m AS ({MESSAGES_SQL}), inc AS (SELECT user_id AS owner, min(id) * 2 AS episode_id, list(id ORDER BY id) AS ids, arg_min(content, id) AS said FROM m GROUP BY user_id, (id // 1000 * 7 + id % 1000 // 3)
UNION ALL SELECT user_id, min(id) * 2 + 1, list(id ORDER BY id), arg_min(content, id) FROM m WHERE (id // 1000 * 7 + (id % 1000 + 1) // 3) % 3 = 0 GROUP BY user_id, (id // 1000 * 7 + (id % 1000 + 1) // 3)),
old AS (SELECT user_id AS owner, list(id ORDER BY id) AS ids FROM m WHERE (id // 1000 * 7 + id % 1000 // 3) % 5 = 0 GROUP BY user_id, (id // 1000 * 7 + id % 1000 // 3) UNION ALL SELECT user_id, [min(id)] FROM m WHERE (id // 1000 * 7 + id % 1000 // 3) % 5 = 1 GROUP BY user_id, (id // 1000 * 7 + id % 1000 // 3)),
k AS (SELECT episode_id FROM inc JOIN old USING (owner, ids)), bad AS (SELECT episode_id FROM inc WHERE episode_id % 7 = 0 OR said = ''),
u AS (SELECT episode_id, owner, unnest(ids) AS id FROM inc WHERE episode_id NOT IN (SELECT episode_id FROM k) AND episode_id NOT IN (SELECT episode_id FROM bad)),
sh AS (SELECT DISTINCT episode_id FROM u JOIN (SELECT owner, unnest(ids) AS id FROM old) USING (owner, id)),
fr AS (SELECT *, min(episode_id) OVER (PARTITION BY owner, id) AS first FROM u WHERE episode_id NOT IN (SELECT episode_id FROM sh)), la AS (SELECT DISTINCT episode_id FROM fr WHERE first < episode_id)"""


@query(f"""WITH {EPISODES_SQL} SELECT episode_id, CASE WHEN episode_id IN (SELECT episode_id FROM k) THEN 'known' WHEN episode_id IN (SELECT episode_id FROM bad) THEN 'unquoted'
WHEN episode_id IN (SELECT episode_id FROM sh) OR episode_id IN (SELECT episode_id FROM la) THEN 'overlaps' ELSE 'created' END AS outcome FROM inc""")
def episode_outcomes(s, d):
    m = messages(s, d).select("id", F.col("user_id").alias("owner"), "content")

    def grouped(rows, block, offset):
        first = F.min(F.struct("id", "content"))
        out = rows.groupBy("owner", block.alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"), first["id"].alias("first"), first["content"].alias("said"))
        return out.withColumn("episode_id", F.col("first") * 2 + offset)

    turn, talk = F.col("id") % 1000, F.floor(F.col("id") / 1000)
    by = talk * 7 + F.floor(turn / 3)
    late = talk * 7 + F.floor((turn + 1) / 3)
    asked = grouped(m, by, 0).unionByName(grouped(m.where(late % 3 == 0), late, 1))
    excerpt = F.when(F.col("episode_id") % 7 == 0, F.concat(F.substring("said", 1, 20), F.lit("~#"))).otherwise(F.substring("said", 1, 20))
    asked = asked.select("episode_id", "owner", "ids", F.array(F.struct(F.col("first").alias("message_id"), excerpt.alias("excerpt"))).alias("excerpts"))
    old = grouped(m.where(by % 5 == 0), by, 0).select("owner", "ids").unionByName(grouped(m.where(by % 5 == 1), by, 0).select("owner", F.array("first").alias("ids")))
    return K.episode_outcomes(asked, old, m)


# -- summaries -------------------------------------------------------------------
@query("""WITH f AS (SELECT o_orderkey AS file_id, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 7 END AS owner, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 9 - 1)::INT AS b, o_orderkey // 4 AS written, o_orderkey % 6 = 0 AS holes FROM orders)
SELECT file_id FROM f WHERE a <= b AND EXISTS (SELECT 1 FROM f g WHERE g.owner = f.owner AND g.a <= f.a AND g.b >= f.b AND NOT g.holes AND (g.written, g.file_id) > (f.written, f.file_id))""")
def superseded_summaries(s, d):
    """Windows of up to eight days, some with holes, some without an owner, some empty; several written at once."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    files = table(s, d, "orders").select(k.alias("file_id"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 7).alias("owner"), day.alias("start_day"), F.date_add(day, (k % 9 - 1).cast("int")).alias("end_day"), F.floor(k / 4).alias("written"), (k % 6 == 0).alias("holes"))
    return Y.superseded(files)


@query("""WITH RECURSIVE i AS (SELECT l_suppkey AS session_id, kind, row_number() OVER (PARTITION BY l_suppkey, kind ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS nr, 20 + l_partkey % 80 AS size
FROM (SELECT *, CASE WHEN l_orderkey % 10 < 6 THEN 'pair' WHEN l_orderkey % 10 < 8 THEN 'daily' WHEN l_orderkey % 10 < 9 THEN 'weekly' ELSE 'quarterly' END AS kind FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_linenumber < 3)),
c AS (SELECT session_id, count(*) FILTER (kind = 'pair') AS np, count(*) FILTER (kind = 'daily') AS nd, count(*) FILTER (kind = 'weekly') AS nw, count(*) FILTER (kind = 'quarterly') AS nq FROM i GROUP BY 1),
r AS (SELECT session_id, 0 AS turn, 0 AS places, least(nd, 1) AS d, 0::BIGINT AS w, 0::BIGINT AS q, ''::VARCHAR AS kind, 0::BIGINT AS nr FROM c
UNION ALL SELECT session_id, turn, places, d + (kind = 'daily')::INT, w + (kind = 'weekly')::INT, q + (kind = 'quarterly')::INT, kind, CASE kind WHEN 'daily' THEN d WHEN 'weekly' THEN w ELSE q END
FROM (SELECT session_id, r.turn + 1 AS turn, r.places + ((r.turn + 1) % 3 = 0)::INT AS places, d, w, q, CASE WHEN (r.turn + 1) % 3 = 0 AND (r.places + 1) % 6 = 0 AND q < nq THEN 'quarterly' WHEN (r.turn + 1) % 3 = 0 AND w < nw THEN 'weekly'
WHEN d < nd THEN 'daily' WHEN w < nw THEN 'weekly' WHEN q < nq THEN 'quarterly' END AS kind FROM r JOIN c USING (session_id) WHERE r.turn < np - 8 AND r.turn < 200) WHERE kind IS NOT NULL),
o AS (SELECT session_id, kind, nr, nr AS place, size + (nr > 0)::INT AS size FROM i WHERE kind = 'pair' AND nr < 8 UNION ALL SELECT session_id, kind, nr, 8, size FROM i WHERE kind = 'daily' AND nr = 0
UNION ALL SELECT session_id, r.kind, r.nr, 8 + turn * 2, size FROM r JOIN i USING (session_id, kind, nr) WHERE turn > 0
UNION ALL SELECT i.session_id, 'pair', i.nr, 9 + (i.nr - 8) * 2, size FROM i WHERE kind = 'pair' AND nr >= 8 AND (nr = 8 OR EXISTS (SELECT 1 FROM r WHERE r.session_id = i.session_id AND r.turn = i.nr - 8)))
SELECT session_id, kind, nr, place FROM (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY place) AS used FROM o) WHERE place <= 8 OR used <= 3000""")
def session_context_fill(s, d):
    """Suppliers as sessions: line items as pairs and summaries, 3000 characters."""
    k = F.col("l_orderkey") % 10
    kind = F.when(k < 6, "pair").when(k < 8, "daily").when(k < 9, "weekly").otherwise("quarterly")
    rows = table(s, d, "lineitem").where("l_suppkey % 3 <> 0 OR l_linenumber < 3").withColumn("kind", kind)
    w = Window.partitionBy("l_suppkey", "kind").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    items = rows.select(F.col("l_suppkey").alias("session_id"), "kind", (F.row_number().over(w) - 1).alias("nr"), (20 + F.col("l_partkey") % 80).alias("size"))
    return Y.session_context(items, 3000)


# -- publication -----------------------------------------------------------------
@query("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE source END AS principal, CASE WHEN doc_id % 3 = 0 THEN 'episode' ELSE 'durable' END AS layer FROM documents WHERE source IS NOT NULL),
c AS (SELECT doc_id, source AS owner, CASE WHEN doc_id % 11 = 0 THEN 'r2' ELSE 'r1' END AS version, CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 1 END AS class, doc_id % 19 = 0 AS sealed, doc_id % 23 = 0 AS replaced FROM documents WHERE doc_id % 29 <> 0),
m AS (SELECT doc_id, unnest([doc_id * 2, doc_id * 2 + 1]) AS id FROM i), me AS (SELECT unnest([doc_id * 2, doc_id * 2 + 1]) AS id, CASE WHEN doc_id % 31 = 0 THEN 'other' ELSE source END AS owner FROM documents),
e AS (SELECT m.doc_id, bool_or(coalesce(me.owner <> i.principal OR m.id % 37 = 0, true)) AS withheld, bool_or(m.id % 47 = 0) AS marked FROM m JOIN i USING (doc_id) LEFT JOIN me USING (id) GROUP BY 1)
SELECT i.doc_id AS item_id, CASE WHEN c.doc_id IS NULL THEN 'stale-version' WHEN c.owner <> principal THEN 'unauthorized-source' WHEN sealed OR class > 2 THEN 'restricted-source' WHEN version <> 'r1' THEN 'stale-version' WHEN replaced THEN 'superseded'
WHEN (layer = 'durable' AND i.doc_id % 41 = 0) OR (layer = 'episode' AND i.doc_id % 43 = 0) THEN 'forgotten' WHEN withheld THEN 'source-withheld' WHEN marked THEN 'forgotten' END AS reason FROM i LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)""")
def publication_recheck(s, d):
    """All documents as results, held against a state in which some are gone, edited, sealed, replaced, forgotten or of another owner."""
    i, docs = F.col("doc_id"), table(s, d, "documents").where("source IS NOT NULL")
    layer = F.when(i % 3 == 0, "episode").otherwise("durable").alias("layer")
    both = F.array(i * 2, i * 2 + 1)
    items = docs.select((i % 50).alias("query_id"), i.alias("item_id"), F.when(i % 13 == 0, "other").otherwise(F.col("source")).alias("principal"), layer, i.alias("record_id"), F.lit("r1").alias("version"), both.alias("refs"))
    now = docs.where("doc_id % 29 <> 0").select(layer, i.alias("record_id"), F.col("source").alias("owner"), F.when(i % 11 == 0, "r2").otherwise("r1").alias("version"), F.when(i % 17 == 0, 3).otherwise(1).alias("classification"), (i % 19 == 0).alias("encrypted"), (i % 23 == 0).alias("replaced"))
    sent = docs.select(F.explode(both).alias("id"), F.when(i % 31 == 0, "other").otherwise(F.col("source")).alias("owner"))
    gone = docs.where("doc_id % 3 <> 0 AND doc_id % 41 = 0 OR doc_id % 3 = 0 AND doc_id % 43 = 0").select(layer, i.alias("record_id"))
    gone = gone.unionByName(sent.where("id % 47 = 0").select(F.lit("message").alias("layer"), F.col("id").alias("record_id")))
    return U.rechecked(items, now, sent.where("id % 37 <> 0"), gone).select("item_id", "reason")
