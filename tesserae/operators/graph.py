"""Entity graph: edges from relations, bounded traversal, related seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation labels that are kept as they are.
LABELS = ["uses", "owns", "works_on", "depends_on", "part_of", "located_in", "related", "created", "prefers", "knows", "caused_by", "replaces"]


def entity(name: Column) -> Column:
    """Collapsed, lower-cased entity of 2 to 64 letters with a letter or digit, else null."""
    plain = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.when(F.length(plain).between(2, 64) & plain.rlike(r"[\p{L}\p{N}]"), plain)


def edges_of(docs: DataFrame, most: int = 8) -> DataFrame:
    """Edges of docs (doc_id, text, relations array<struct<a,rel,b>>): both ends must stand in the text; unknown labels are "related"."""
    r = docs.select("doc_id", F.lower("text").alias("__text"), F.posexplode(F.slice("relations", 1, most)).alias("pos", "r"))
    ends = r.select("doc_id", "__text", entity(F.col("r.a")).alias("a"), entity(F.col("r.b")).alias("b"), F.col("r.rel").alias("rel"))
    kept = ends.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")) & F.contains("__text", "a") & F.contains("__text", "b"))
    label = F.when(F.col("rel").isin(LABELS), F.col("rel")).otherwise("related")
    return kept.select("doc_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), label.alias("rel")).distinct()


def reached(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, hop): nodes within ``hops`` of the seeds of each query; the frontier alone is joined, visited nodes are not met again."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = frontier = seeds.select("query_id", "node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier.node == both.a).select("query_id", F.col("b").alias("node")).distinct()
        frontier = step.join(seen, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def edge_candidates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, a, b, hop): each edge once per query, at the first hop from which it is seen."""
    at = nodes.select("query_id", F.col("node").alias("a"), F.col("hop").alias("ha"))
    bt = nodes.select("query_id", F.col("node").alias("b"), F.col("hop").alias("hb"))
    one = edges.join(at, "a").select("query_id", "a", "b", F.col("ha").alias("hop"))
    two = edges.join(bt, "b").select("query_id", "a", "b", F.col("hb").alias("hop"))
    return one.unionByName(two).groupBy("query_id", "a", "b").agg(F.min("hop").alias("hop"))


def related(edges: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """Entities next to a query's seeds by number of edges, the best first."""
    from pyspark.sql import Window

    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(seeds.select("query_id", F.col("node").alias("a")), "a").groupBy("query_id", F.col("b").alias("node")).agg(F.count("*").alias("degree"))
    near = near.join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("degree"), "node")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


#: Hops, nodes and edges of a search by profile.
GRAPH_BUDGETS = {"fast": (1, 64, 128), "normal": (2, 256, 512), "full": (3, 1024, 2048)}


def budgeted(edges: DataFrame, seeds: DataFrame, hops: int, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """Bounded search, edge by edge: the visited edges (query_id, edge_id, hop, place, anchored) and nodes (query_id, node, hop, place, anchored).

    edges: edge_id, a, b (undirected, each id once); seeds: query_id, node, place, anchored. A hop takes the nodes of the
    last one in order of their place and the edges of each by id. An edge is visited once; the node behind it
    is new if nobody has reached it, and inherits whether its search began at an anchor. The search ends for good
    before the first edge at which ``most_edges`` edges or ``most_nodes`` nodes are there.

    What one query looks at is bounded before any join, and nothing that counts is lost. Of a node's edges the first
    ``most_edges`` by id are enough: before a later one stand as many, each of which was visited before or comes earlier
    in this hop, so the search has ended. An edge is met at two nodes of a hop at most: once the nodes before one have
    twice ``most_edges`` edges, as many different ones come before its own.
    """
    from pyspark.sql import Window

    from ..shared import written

    ends = edges.select("edge_id", "a", "b").where("a <> b")
    both = ends.unionAll(ends.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(edges.where("a = b").select("edge_id", "a", "b"))
    per = Window.partitionBy("a").orderBy("edge_id")
    both = both.withColumn("__k", F.row_number().over(per)).where(F.col("__k") <= most_edges)
    near = written(both.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("edge_id", "b"))).alias("near")))
    nodes = written(seeds.join(near.select(F.col("a").alias("node")), "node", "left_semi").select("query_id", "node", F.lit(0).alias("hop"), F.col("place").cast("long").alias("place"), "anchored"))
    visited = nodes.select("query_id", F.lit(0).cast("long").alias("edge_id"), "hop", "place", "anchored").limit(0)
    frontier = nodes
    once = Window.partitionBy("query_id", "a").orderBy("at")
    earlier = Window.partitionBy("query_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    for hop in range(1, hops + 1):
        sized = frontier.select("query_id", F.col("node").alias("a"), F.col("place").alias("at"), "anchored").join(near.select("a", F.size("near").alias("n")), "a")
        sized = sized.withColumn("n", F.when(F.row_number().over(once) == 1, F.col("n")).otherwise(0))
        sized = sized.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("__before") < 2 * most_edges)
        step = sized.select("query_id", "a", "at", "anchored").join(near, "a").select("query_id", "at", "anchored", F.inline("near"))
        step = step.join(visited.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
        # An edge counts where it is met first.
        first = step.groupBy("query_id", "edge_id").agg(F.min(F.struct("at", "b", "anchored")).alias("m")).select("query_id", "edge_id", "m.at", "m.b", "m.anchored")
        counts = nodes.groupBy("query_id").agg(F.count("*").alias("n0")).join(visited.groupBy("query_id").agg(F.count("*").alias("e0")), "query_id", "left")
        old = nodes.select("query_id", F.col("node").alias("b"), F.lit(True).alias("old"))
        rows = first.join(old, ["query_id", "b"], "left").join(counts, "query_id")
        order = Window.partitionBy("query_id").orderBy("at", "edge_id")
        here = Window.partitionBy("query_id", "b").orderBy("at", "edge_id")
        rows = rows.withColumn("new", F.col("old").isNull() & (F.row_number().over(here) == 1))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({"i": F.row_number().over(order) - 1, "found": F.coalesce(F.sum(F.col("new").cast("long")).over(before), F.lit(0))})
        done = written(rows.where((F.coalesce("e0", F.lit(0)) + F.col("i") < most_edges) & (F.col("n0") + F.col("found") < most_nodes)))
        visited = visited.unionByName(done.select("query_id", "edge_id", F.lit(hop).alias("hop"), F.col("i").cast("long").alias("place"), "anchored"))
        frontier = done.where("new").select("query_id", F.col("b").alias("node"), F.lit(hop).alias("hop"), F.col("i").cast("long").alias("place"), "anchored")
        nodes = nodes.unionByName(frontier)
    return visited, nodes


def edge_hits(visited: DataFrame, edges: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """(query_id, edge_id, doc_id, hop, anchored, rank): visited edges whose source (src_id, src_version) is a document of that version, in the order of the search."""
    from pyspark.sql import Window

    known = documents.select("doc_id", F.col("doc_id").alias("src_id"), F.col("version").alias("src_version"))
    there = visited.join(edges.select("edge_id", "src_id", "src_version"), "edge_id").join(known, ["src_id", "src_version"])
    w = Window.partitionBy("query_id").orderBy("hop", "place")
    return there.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most).select("query_id", "edge_id", "doc_id", "hop", "anchored", "rank")
