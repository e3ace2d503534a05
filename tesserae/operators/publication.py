"""The recheck before results are published: what changed since they were found is left out, never replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes above this are never published.
CEILING = 2


def rechecked(items: DataFrame, current: DataFrame, messages: DataFrame, forgotten: DataFrame) -> DataFrame:
    """items with ``reason``: why an item is withheld against a later state of its sources, null if it may be published.

    items: query_id, item_id, principal, layer, record_id, version, refs (array of message ids); current: layer, record_id, owner,
    version, classification, encrypted, replaced; messages: id, owner; forgotten: layer (durable, episode, message), record_id.
    The first reason counts: a record that is gone or of another version is ``stale-version``, another owner's
    ``unauthorized-source``, one above the ceiling or encrypted ``restricted-source``; then ``superseded`` and
    ``forgotten``; then its messages: gone or another owner's ``source-withheld``, else ``forgotten``. Unknown classes count as above.

    Items meet their records, messages and marks on equal keys; nothing of a snapshot is collected.
    """
    c = current.select("layer", "record_id", F.col("owner").alias("__owner"), F.col("version").alias("__version"), F.col("classification").alias("__class"), F.coalesce("encrypted", F.lit(False)).alias("__sealed"), F.coalesce("replaced", F.lit(False)).alias("__replaced"))
    gone = forgotten.select("layer", "record_id", F.lit(True).alias("__gone")).distinct()
    refs = items.select("query_id", "item_id", "principal", F.explode(F.coalesce("refs", F.array().cast("array<bigint>"))).alias("id"))
    marks = forgotten.where("layer = 'message'").select(F.col("record_id").alias("id"), F.lit(True).alias("__mark")).distinct()
    seen = refs.join(messages.select("id", F.col("owner").alias("__sender")), "id", "left").join(marks, "id", "left")
    withheld = F.coalesce(F.col("__sender") != F.col("principal"), F.lit(True))
    evidence = seen.groupBy("query_id", "item_id").agg(F.max(withheld).alias("__withheld"), F.max(F.coalesce("__mark", F.lit(False))).alias("__marked"))
    rows = items.join(c, ["layer", "record_id"], "left").join(gone, ["layer", "record_id"], "left").join(evidence, ["query_id", "item_id"], "left")
    reason = (
        F.when(F.col("__version").isNull(), "stale-version")
        .when(F.coalesce(F.col("__owner") != F.col("principal"), F.lit(True)), "unauthorized-source")
        .when(F.col("__sealed") | F.coalesce(F.col("__class") > CEILING, F.lit(True)), "restricted-source")
        .when(~F.col("__version").eqNullSafe(F.col("version")), "stale-version")
        .when(F.col("__replaced"), "superseded")
        .when(F.col("__gone"), "forgotten")
        .when(F.col("__withheld"), "source-withheld")
        .when(F.col("__marked"), "forgotten")
    )
    return rows.select(*items.columns, reason.alias("reason"))
