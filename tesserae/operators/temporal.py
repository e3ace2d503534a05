"""Validity, revisions, beliefs, coverage, calendars and covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(day: Column, since: Column, until: Column) -> Column:
    """Half-open validity; null bounds are open."""
    return (since.isNull() | (since <= day)) & (until.isNull() | (day < until))


def scope_fits(stored: Column, asked: Column) -> Column:
    """Every stored constraint but a general scope equals the request's (maps of strings)."""
    return F.forall(F.map_entries(stored), lambda e: ((e.key == "scope") & (e.value == "general")) | asked[e.key].eqNullSafe(e.value))


def revisions(changes: DataFrame, key: str, since: str) -> DataFrame:
    """Slowly changing history: each change closes the one before; the last stays open."""
    w = Window.partitionBy(key).orderBy(since, "change_id")
    return changes.withColumns({"revision": F.row_number().over(w), "valid_to": F.lead(since).over(w), "is_current": F.lead(since).over(w).isNull()})


def as_of(history: DataFrame, asks: DataFrame, key: str, since: str, day: str) -> DataFrame:
    """For each ask (key, day) the highest revision valid then; an ask without one is left out."""
    hit = asks.join(history, key).where(valid_at(F.col(day), F.col(since), F.col("valid_to")))
    w = Window.partitionBy(key, day).orderBy(F.desc("revision"))
    return hit.withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1).drop("__k")


def resolved_beliefs(facts: DataFrame) -> DataFrame:
    """Current belief per claim of facts (user_id, claim, fact_id, authority, scope map): authoritative ones if any, dominated ones dropped.

    A fact is dominated when another of the claim has all its constraints and more. A claim is
    resolved when one fact is left.
    """
    w = Window.partitionBy("user_id", "claim")
    strong = F.col("authority").isin("user", "confirmed")
    held = facts.withColumn("__strong", F.max(strong.cast("int")).over(w)).where((F.col("__strong") == 0) | strong).drop("__strong")
    other = held.select("user_id", "claim", F.col("fact_id").alias("other_id"), F.col("scope").alias("other"))
    wider = (F.size("other") > F.size("scope")) & F.forall(F.map_entries("scope"), lambda e: F.col("other")[e.key].eqNullSafe(e.value))
    left = held.join(held.join(other, ["user_id", "claim"]).where(wider).select("fact_id").distinct(), "fact_id", "left_anti")
    return left.withColumn("resolved", F.count("*").over(w) == 1)


#: Facts of a group that are one part of its pairs.
CONFLICT_PART = 1000


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs of facts of one user and type on the same topic (a missing topic meets all) with different contents.

    All pairs of a group may be asked for. Its facts are dealt into parts of some CONFLICT_PART, each of which meets the whole
    group apart from the others, so a large group is the work of many tasks.
    """
    group = ["user_id", "kind"]
    parts = facts.groupBy(*group).agg(F.ceil(F.count("*") / CONFLICT_PART).cast("int").alias("__parts"))
    rows = facts.select("fact_id", "topic", "content", *group).join(parts, group)
    a = rows.withColumn("__part", F.pmod(F.xxhash64("fact_id"), "__parts").cast("int")).alias("a")
    b = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.__part") == F.col("b.__part")) & (F.col("a.fact_id") < F.col("b.fact_id"))
    topic = F.col("a.topic").isNull() | F.col("b.topic").isNull() | (F.col("a.topic") == F.col("b.topic"))
    return a.join(b, same & topic & (F.col("a.content") != F.col("b.content"))).select("a.user_id", F.col("a.fact_id").alias("a_id"), F.col("b.fact_id").alias("b_id"))


def coverage_ceiling(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Latest time up to which a principal's log is claimed: the target, or just before the first unclaimed start; null without claims or with a malformed one."""
    good = F.bool_and(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull() & (F.col("start_ts") <= F.col("end_ts")))
    hole = F.min(F.when(F.col("disposition") == "unclaimed", F.col("start_ts")))
    seen = claims.groupBy("principal").agg(good.alias("good"), hole.alias("hole"))
    ceiling = F.when(F.col("good"), F.least("target", F.coalesce(F.col("hole") - 1, F.col("target"))))
    return targets.join(seen, "principal", "left").select("principal", ceiling.alias("ceiling"))


def merged_intervals(claims: DataFrame, by: list[str]) -> DataFrame:
    return claims.groupBy(*by).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))


def newest_covers(days: DataFrame, covers: DataFrame) -> DataFrame:
    """For each day the newest cover that holds it, path on ties: covers are spread over their days, so the join is on equal days."""
    spread = covers.select("path", "stamp", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    best = spread.groupBy("day").agg(F.max_by("path", F.struct("stamp", "path")).alias("path"))
    return days.join(best, "day", "left")


def overlapping_periods(covers: DataFrame, weeks: DataFrame) -> DataFrame:
    """(path, week): covers that touch a week; by the weeks that a cover spans, on equal keys."""
    spread = covers.select("path", F.explode(F.sequence(F.date_trunc("week", "start_day").cast("date"), F.col("end_day"), F.expr("interval 7 days"))).alias("week"))
    return spread.join(weeks.select("week"), "week").select("path", "week").distinct()


def due_weeks(days: DataFrame, today: Column, back: int = 8) -> DataFrame:
    """Completed weeks with days, not older than ``back`` weeks, without a summary (days: day, summarised)."""
    weeks = days.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count("*").alias("n_days"), F.max(F.col("summarised").cast("int")).alias("done"))
    this = F.date_trunc("week", today).cast("date")
    return weeks.where((F.col("week") < this) & (F.col("week") >= F.date_sub(this, 7 * back)) & (F.col("done") == 0)).select("week", "n_days")


def missing_days(days: DataFrame, start: str, end: str) -> DataFrame:
    calendar = days.sparkSession.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day")
    return calendar.join(days.select("day").distinct(), "day", "left_anti")


def quarter_bounds(day: Column) -> tuple[Column, Column]:
    first = F.date_trunc("quarter", day).cast("date")
    return first, F.date_sub(F.add_months(first, 3), 1)


def period_of(name: Column) -> tuple[Column, Column, Column]:
    """(kind, first day, last day) of a summary's file name: 2024-01-31-0815.md, 2024-W05.md, 2024-Q1.md; nulls for others."""
    day = F.try_to_date(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-\d{4}\.md$", 1))
    week = F.regexp_extract(name, r"^(\d{4})-W(\d{2})\.md$", 2).try_cast("int")
    year = F.regexp_extract(name, r"^(\d{4})-[WQ]", 1)
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")))
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (week - 1) * 7)
    quarter = F.regexp_extract(name, r"^\d{4}-Q([1-4])\.md$", 1).try_cast("int")
    first = F.add_months(F.try_to_date(F.concat(year, F.lit("-01-01"))), (quarter - 1) * 3)
    kind = F.when(day.isNotNull(), "daily").when(week.isNotNull(), "weekly").when(quarter.isNotNull(), "quarterly")
    start = F.coalesce(day, F.when(week.isNotNull(), monday), F.when(quarter.isNotNull(), first))
    end = F.coalesce(day, F.when(week.isNotNull(), F.date_add(monday, 6)), F.when(quarter.isNotNull(), F.date_sub(F.add_months(first, 3), 1)))
    return kind, start, end


def superseded(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current rows after the edits, closed revisions, scoped exceptions).

    An edit (id, expected_revision, content, scope, day) of the row's own scope closes it and
    raises its revision if the expected one holds; one of another scope leaves it and adds an
    exception that names it.
    """
    tried = edits.select("id", "expected_revision", F.col("content").alias("__content"), F.col("scope").alias("__scope"), "day")
    met = current.join(tried, "id", "left")
    fits = F.coalesce(F.col("expected_revision") == F.col("revision"), F.lit(False))
    same = fits & F.col("__scope").eqNullSafe(F.col("scope"))
    after = met.select("id", F.when(same, F.col("__content")).otherwise(F.col("content")).alias("content"), "scope", (F.col("revision") + same.cast("int")).alias("revision"), F.when(same, F.col("day")).otherwise(F.col("valid_from")).alias("valid_from"))
    closed = met.where(same).select("id", "content", "scope", "revision", "valid_from", F.col("day").alias("valid_to"))
    exceptions = met.where(fits & ~F.col("__scope").eqNullSafe(F.col("scope"))).select(F.col("id").alias("exception_of"), F.col("__content").alias("content"), F.col("__scope").alias("scope"), F.col("day").alias("valid_from"))
    return after, closed, exceptions
