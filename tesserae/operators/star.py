"""The projection star: documents with the durable facts, episodes and vectors they stand for.

All four tables are bucketed and sorted by one key, which names a record by layer, owner and id, so the joins
need no shuffle however large they are. The key is one string because bucketing by several columns is
lost as soon as a join has one more condition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "durables", "episodes", "vectors")


def record_key(layer: Column, owner: Column, record_id: Column) -> Column:
    """Null if a part is null, so such records meet nothing."""
    return F.concat(layer, F.lit(":"), owner, F.lit(":"), record_id.cast("string"))


def saved(tables: dict[str, DataFrame], buckets: int = 8, name: str | None = None) -> str:
    """Write the tables (each with ``key``) bucketed by key; the name by which ``joined`` finds them."""
    name = name or f"star_{uuid.uuid4().hex}"
    for part in TABLES:
        tables[part].repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet").mode("overwrite").saveAsTable(f"{name}_{part}")
    return name


def dropped(spark: SparkSession, name: str) -> None:
    for part in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def joined(spark: SparkSession, name: str) -> DataFrame:
    """Every document with its fact, episode and current vector, where there are any.

    documents: key, layer, version, ...; durables: key, memory_type, created_at, content; episodes: key, topic, prominence,
    start_ts; vectors: key, version, vector. A vector of another version counts as none. Keys are unique in each table.
    The merge hint keeps the joins on the buckets where a side is small enough to be broadcast.
    """
    docs, facts, episodes, vectors = (spark.table(f"{name}_{part}") for part in TABLES)
    facts = facts.select("key", "memory_type", "created_at", F.col("content").alias("fact"))
    episodes = episodes.select("key", "topic", "prominence", "start_ts")
    vectors = vectors.select("key", F.col("version").alias("vector_version"), "vector")
    out = docs
    for side in (facts, episodes, vectors):
        out = out.join(side.hint("merge"), "key", "left")
    return out.withColumn("vector", F.when(F.col("vector_version") == F.col("version"), F.col("vector")))


def narrowed(star: DataFrame, memory_type: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Optional filters on the joined rows: a type lets episodes through; times are those of the record, inclusive."""
    test, at = F.lit(True), F.when(F.col("layer") == "durable", F.col("created_at")).otherwise(F.col("start_ts"))
    if memory_type is not None:
        test = test & ((F.col("layer") == "episode") | (F.col("memory_type") == memory_type))
    if start is not None:
        test = test & (at >= start)
    if end is not None:
        test = test & (at <= end)
    return star.where(test)


def durable_documents(facts: DataFrame) -> DataFrame:
    """Documents of facts (owner, id, revision, content, content_original, scope, authority, classification, evidence array<long>).

    The version is the revision; a fact that ended, is sealed (classification above 2), encrypted or replaced has none.
    """
    there = F.col("superseded_by").isNull() & (F.col("classification") <= 2) & ~F.coalesce(F.col("encrypted"), F.lit(False))
    return facts.where(there).select(
        record_key(F.lit("durable"), F.col("owner"), F.col("id")).alias("key"),
        F.lit("durable").alias("layer"),
        "owner",
        F.col("id").alias("record_id"),
        F.concat(F.lit("r"), F.col("revision").cast("string")).alias("version"),
        F.col("content").alias("safe_text"),
        F.coalesce("content_original", F.lit("")).alias("original_text"),
        "scope",
        "authority",
        "classification",
        F.array_distinct(F.coalesce("evidence", F.array().cast("array<bigint>"))).alias("source_refs"),
    )
