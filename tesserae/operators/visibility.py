"""Who may see what: ownership, classes, scopes, sealed values, superseded retellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import held

#: Classes above this are never recalled.
CEILING = 2


def searchable(owner: str | None, generation: int, ceiling: int = CEILING, durable_only: bool = False) -> Column:
    """Documents of the owner in the live generation, up to the class; the fast profile sees durable ones only."""
    if owner is None:
        return F.lit(False)
    test = (F.col("owner") == owner) & (F.col("generation") == generation) & (F.col("classification") <= min(ceiling, CEILING))
    return test & (F.col("layer") == "durable") if durable_only else test


def shared_or_owned(principal: str | None, ceiling: int) -> Column:
    """Up to the ceiling; classes 0 and 1 are shared, above them only the owner's; nobody sees nothing."""
    if principal is None:
        return F.lit(False)
    return (F.col("classification") <= ceiling) & ((F.col("classification") <= 1) | (F.col("owner") == principal))


def visible_to(principal: Column, ceiling: int) -> Column:
    """``shared_or_owned`` for principals of a column: a null one sees nothing."""
    return F.coalesce(principal.isNotNull() & (F.col("classification") <= ceiling) & ((F.col("classification") <= 1) | (F.col("owner") == principal)), F.lit(False))


def eligible(today: str) -> Column:
    """Current, not above the ceiling, neither encrypted nor sealed, not yet ended."""
    return F.col("superseded_by").isNull() & (F.col("classification") <= CEILING) & ~F.col("encrypted") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.to_date(F.lit(today))))


def narrowed(memory_type: str | None = None, scope: str | None = None, start: int | None = None, end: int | None = None) -> Column:
    """Optional filters: a type lets episodes through, a scope also admits general rows, times are inclusive."""
    test = F.lit(True)
    if memory_type is not None:
        test = test & ((F.col("layer") == "episode") | (F.col("memory_type") == memory_type))
    if scope is not None:
        test = test & F.col("scope").isin(scope, "general")
    if start is not None:
        test = test & (F.col("at") >= start)
    if end is not None:
        test = test & (F.col("at") <= end)
    return test


def consumed_scope(session: Column) -> Column:
    """Sessions of the kinds A and C, without a name, or with fewer than two underscores."""
    return session.like(r"%\_A\_%") | session.like(r"%\_C\_%") | (session == "") | (F.length(session) - F.length(F.translate(session, "_", "")) < 2)


def retold(excerpts: DataFrame, old: DataFrame, current: DataFrame, size: int = 160, least: int = 40) -> DataFrame:
    """Excerpts (owner, excerpt_id, excerpt) whose beginning stands in a superseded text of the owner and in no current one."""
    head = excerpts.withColumn("__head", F.substring(F.trim("excerpt"), 1, size)).where(F.length("__head") >= least).select("excerpt_id", F.col("owner").cast("string").alias("owner"), "__head")
    heads = head.select("owner", F.col("__head").alias("string"))
    texts = lambda rows, now: rows.select("owner", F.lit(now).alias("id"), F.col("content").alias("text"))
    seen = held(texts(old, False).unionByName(texts(current, True)), heads).groupBy("owner", F.col("string").alias("__head")).agg(F.max("id").alias("now"))
    return head.join(seen.where("NOT now"), ["owner", "__head"]).select("excerpt_id").distinct()


def safe_evidence(messages: DataFrame, episodes: DataFrame, ceiling: int) -> DataFrame:
    """Messages (id) that no episode (message_ids, sensitivity) above the ceiling holds; an episode of unknown sensitivity counts as above."""
    sealed = episodes.where(F.coalesce(F.col("sensitivity") > ceiling, F.lit(True))).select(F.explode("message_ids").alias("id"))
    return messages.join(sealed, "id", "left_anti")


def without_value(messages: DataFrame, values: DataFrame) -> DataFrame:
    """Messages of a user that hold none of the user's sealed values."""
    texts = messages.select(F.col("user_id").alias("owner"), "id", F.col("content").alias("text"))
    hit = held(texts, values.select(F.col("user_id").alias("owner"), F.col("value").alias("string"))).select("id").distinct()
    return messages.join(hit, "id", "left_anti")
