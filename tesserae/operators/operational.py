"""Scoped, versioned operational knowledge: scope ladder, compare-and-swap, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels from the narrowest to the widest.
LEVELS = ["task_environment", "repository", "workspace", "host", "platform", "global"]


def scope_value(value: Column) -> Column:
    plain = F.lower(F.trim(value))
    return F.when(F.length(plain) > 0, plain)


def scope_rank(asked: dict[str, str]) -> Column:
    """0 for the narrowest level that matches the request; null where none does."""
    rank = None
    for k, level in enumerate(LEVELS):
        hit = (F.col("scope_level") == level) & (F.lit(level == "global") | (F.col(level) == F.lit(asked.get(level))) if level != "global" else F.lit(True))
        rank = F.when(hit, k) if rank is None else rank.when(hit, k)
    return rank


def scoped(memories: DataFrame, asked: dict[str, str], limit: int) -> DataFrame:
    """Memories of matching scopes: narrowest first, newest first."""
    ranked = memories.withColumn("scope_rank", scope_rank(asked)).where("scope_rank IS NOT NULL AND status = 'active'")
    return ranked.orderBy("scope_rank", F.desc("updated_at"), F.desc("id")).limit(limit)


def page_after(rows: DataFrame, updated_at: int, last_id: int, limit: int) -> DataFrame:
    """Keyset page: rows after (updated_at, id) in descending order, one more than asked to tell whether more follow."""
    after = (F.col("updated_at") < updated_at) | ((F.col("updated_at") == updated_at) & (F.col("id") < last_id))
    return rows.where(after).orderBy(F.desc("updated_at"), F.desc("id")).limit(limit + 1)


def content_hash(*fields: Column, domain: str = "operational") -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(domain), *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def swapped(memories: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare-and-swap: (memories after edits whose expected hash holds, edits in conflict). Of several edits of one memory the first wins."""
    w = Window.partitionBy("id").orderBy("edit_id")
    tried = edits.withColumn("__k", F.row_number().over(w)).join(memories.select("id", F.col("content_hash").alias("__hash")), "id", "left")
    good = F.coalesce((F.col("__hash") == F.col("expected_hash")) & (F.col("__k") == 1), F.lit(False))
    applied = tried.where(good).select("id", F.col("content").alias("__content"), F.col("edit_id").alias("__edit"))
    out = memories.join(applied, "id", "left").withColumns({"content": F.coalesce("__content", "content"), "content_hash": F.when(F.col("__edit").isNotNull(), content_hash(F.col("__content"))).otherwise(F.col("content_hash")), "version": F.col("version") + F.col("__edit").isNotNull().cast("int")})
    return out.drop("__content", "__edit"), tried.where(~good).select(*edits.columns)


def mentions_all(text: Column, tokens: list[str]) -> Column:
    norm = F.lower(text)
    return F.forall(F.array(*map(F.lit, tokens)), lambda t: norm.contains(F.lower(t)))


def current_versions(memories: DataFrame, versions: DataFrame) -> DataFrame:
    return memories.join(versions, (memories.id == versions.memory_id) & (memories.current_version_id == versions.version_id))


def lineage(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("memory_id").orderBy(F.desc("version_id"))
    return versions.withColumn("age", F.row_number().over(w) - 1)


def fragmented(names: DataFrame) -> DataFrame:
    """Groups of names that share what stands before the first hyphen."""
    core = F.split("name", "-")[0]
    return names.groupBy(core.alias("core")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")).where("n > 1")
