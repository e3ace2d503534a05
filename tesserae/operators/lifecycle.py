"""Retention, forgetting, evidence and index reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prunable(exchanges: DataFrame, keep: int, covered: int) -> DataFrame:
    """Oldest complete exchanges beyond the newest ``keep`` of a user, ended by the covered time."""
    w = Window.partitionBy("user_id").orderBy(F.desc("end_ts"), F.desc("exchange"), "session_id")
    return exchanges.where("complete = 1").withColumn("age_rank", F.row_number().over(w)).where((F.col("age_rank") > keep) & (F.col("end_ts") <= covered)).drop("age_rank")


def forget_closure(roots: DataFrame, lineage: DataFrame, hops: int = 3) -> DataFrame:
    """(kind, id) of everything derived from the roots: lineage (kind, id, source_kind, source_id), a few bounded steps."""
    seen = step = roots.select("kind", "id").distinct()
    for _ in range(hops):
        above = step.select(F.col("kind").alias("source_kind"), F.col("id").alias("source_id"))
        step = lineage.join(above, ["source_kind", "source_id"]).select("kind", "id").distinct().join(seen, ["kind", "id"], "left_anti")
        seen = seen.unionByName(step)
    return seen


def unsuppressed(rows: DataFrame, markers: DataFrame, key: str = "id", digest: str | None = None) -> DataFrame:
    """Rows that no marker names, by id or by digest of their text."""
    out = rows.join(markers.select(F.col("record_id").alias(key)), key, "left_anti")
    return out.join(markers.select(F.col("digest").alias(digest)), digest, "left_anti") if digest else out


def redacted_episodes(eps: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Episodes without forgotten message ids; mixed ones get a neutral topic, emptied ones go."""
    gone = forgotten.select(F.col("id").alias("__id")).distinct()
    hit = eps.select("user_id", "grp", F.explode("ids").alias("__id")).join(gone, "__id", "left_semi").groupBy("user_id", "grp").agg(F.collect_set("__id").alias("__gone"))
    left = F.array_except("ids", F.coalesce("__gone", F.array().cast("array<bigint>")))
    out = eps.join(hit, ["user_id", "grp"], "left").withColumns({"topic": F.when(F.col("__gone").isNotNull(), "redacted discussion").otherwise(F.col("topic")), "ids": left})
    return out.where(F.size("ids") > 0).drop("__gone")


def supported(evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """Evidence whose excerpt is a quote of its live message, in the stated role, at no lower class."""
    m = messages.select(F.col("id").alias("message_id"), F.col("role").alias("__role"), F.col("content").alias("__content"), F.col("classification").alias("__class"))
    return evidence.join(m, "message_id").where(F.contains("__content", "excerpt") & (F.col("role") == F.col("__role")) & (F.col("classification") >= F.col("__class"))).drop("__role", "__content", "__class")


def older_than(rows: DataFrame, now: int, age: int, claimed: Column | None = None) -> DataFrame:
    """Rows to flush: older than the age, and claimed if claims guard them."""
    return rows.where((F.col("ts") < now - age) & (F.lit(True) if claimed is None else claimed))


def first_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("id").agg(F.min("at").alias("at"))


def reconciliation(eligible: DataFrame, indexed: DataFrame) -> DataFrame:
    """missing, stale or orphaned index entries by a full outer join on the record."""
    e = eligible.select("record_id", F.col("version").alias("__want"))
    i = indexed.select("record_id", F.col("version").alias("__have"))
    state = F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "orphaned").when(F.col("__have") != F.col("__want"), "stale")
    return e.join(i, "record_id", "full").select("record_id", state.alias("state")).where("state IS NOT NULL")


def episode_version(*fields: Column) -> Column:
    """SHA-256 of the fields, nulls as empty, joined by a zero character."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(f, F.lit("")) for f in fields)), 256)


def published(spark, tables: dict[str, DataFrame], path: str, generation: int, checks: dict[str, Column]) -> str:
    """Write a generation beside the live one, verify it, then move the pointer; a failed check leaves the pointer alone."""
    base = f"{path.rstrip('/')}/generation={generation}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    for name, ok in checks.items():
        if spark.read.parquet(f"{base}/{name}").where(~F.coalesce(ok, F.lit(False))).limit(1).count():
            raise ValueError(f"generation {generation}: {name} fails its check")
    spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/current")
    return base


def contradiction_candidates(facts: DataFrame, index: DataFrame, per: int = 20, words: int = 3) -> DataFrame:
    """(fact_id, other_id): other facts of the user that share one of the first long words of a fact, the closest first.

    facts: fact_id, user_id, text; index: term, fact_id, user_id.
    """
    from .retrieval import terms_of

    long = F.slice(F.array_distinct(F.filter(terms_of(F.col("text")), lambda w: F.length(w) > 3)), 1, words)
    asked = facts.select("fact_id", "user_id", F.explode(long).alias("term"))
    hits = asked.join(index.select("term", "user_id", F.col("fact_id").alias("other_id")), ["term", "user_id"]).where("fact_id <> other_id")
    counted = hits.groupBy("fact_id", "other_id").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("fact_id").orderBy(F.desc("shared"), "other_id")
    return counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per).drop("k")


def first_in_window(rows: DataFrame, key: str, ms: int) -> DataFrame:
    """Rows that are recorded when a row is skipped if one of its key was recorded less than ``ms`` before it.

    What is recorded depends on what was recorded before, so times are folded in order per
    key; only times and ids enter the fold.
    """
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("rows"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        new = acc.last.isNull() | (r.ts - acc.last >= ms)
        return F.struct(F.when(new, r.ts).otherwise(acc.last).cast("bigint").alias("last"), F.when(new, F.concat(acc.out, F.array(r.id))).otherwise(acc.out).alias("out"))

    return listed.select(F.explode(F.aggregate("rows", start, step, lambda a: a.out)).alias("id"))
