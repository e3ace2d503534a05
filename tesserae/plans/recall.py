"""The read path for a batch of queries: stages as frames of (query_id, doc_id, field, rank), then fusion, tiers, diversity and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..shared import written
from .probes import DOC_ROWS, Lexical


def recalled(
    docs: DataFrame,
    queries: DataFrame,
    index: str,
    profile: str = "normal",
    contexts: DataFrame | None = None,
    extra: list[DataFrame] | None = None,
    seen: DataFrame | None = None,
    required: DataFrame | None = None,
) -> DataFrame:
    """query_id, doc_id, tier, score, place: docs (doc_id, text), queries (query_id, text), the path of the published index of docs.

    ``contexts`` (query_id, text) adds the context plan at half weight; ``extra`` adds other stages' ranks (vectors,
    graph); ``seen`` (query_id, doc_id) leaves out what earlier pages gave; ``required`` (query_id, doc_id) holds up to half
    of the places for those of its rows that were found. All queries of the batch share each stage's job, and whole
    texts are read only of documents that a stage found.
    """
    budget = R.PROFILES[profile]
    words = queries.select("query_id", T.significant_terms(F.col("text")).alias("terms"))
    ranks = Lexical(docs.sparkSession, index).ranks(queries, contexts, budget["lexical"])
    for stage in extra or []:
        ranks = ranks.unionByName(stage)
    if seen is not None:
        ranks = ranks.join(seen, ["query_id", "doc_id"], "left_anti")
    # Documents go to Python with all their asked words, so few at once.
    found = written(R.capped(R.fused(ranks), budget["fused"]), batch_rows=DOC_ROWS)
    rows = docs.select("doc_id", "text").join(found, "doc_id").join(words, "query_id")
    rows = rows.withColumn("cover", R.coverage(F.col("text"), F.col("terms")))
    bound = (F.col("cover") > 0) | (F.col("embedding") == 1) | (F.col("context") == 1)
    rows = rows.where(F.lit(profile == "full") | bound)
    rows = rows.withColumn("score", R.floored(F.col("score"), F.col("cover"), F.col("lexical"), F.col("context")))
    ranked = R.diversified(rows.select("query_id", "doc_id", R.tier(F.col("cover")).alias("tier"), F.col("text").alias("content"), "score"), ["query_id", "tier"])
    if required is not None:
        marked = ranked.join(required.select("query_id", "doc_id", F.lit(True).alias("required")).distinct(), ["query_id", "doc_id"], "left")
        ranked = R.selected(marked.withColumn("required", F.coalesce("required", F.lit(False))), budget["items"]).drop("required")
    w = Window.partitionBy("query_id").orderBy(F.desc("tier"), "place")
    return ranked.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < budget["items"]).select("query_id", "doc_id", "tier", "score", "place")
