"""Which weekly and quarterly summaries are due for each owner, and which files go into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: weeks that one weekly summary covers at most, and that late files are looked for.
WEEKS = 8


def last_sunday(day: Column) -> Column:
    """The Sunday before a day; before a Sunday the one a week earlier."""
    return F.date_sub(day, F.weekday(day) + 1)


def checkpoints(artifacts: DataFrame) -> DataFrame:
    """(owner, path, start_day, end_day): each owner's valid artifact of the latest end, the larger path on ties."""
    best = artifacts.where("valid").groupBy("owner").agg(F.max_by(F.struct("path", "start_day", "end_day"), F.struct("end_day", "path")).alias("best"))
    return best.select("owner", "best.*")


def incomplete_folders(artifacts: DataFrame) -> DataFrame:
    """(folder): more files than were opened, and none of the opened ones is valid: the latest artifact may be among the rest."""
    return artifacts.groupBy("folder").agg(F.bool_or("more").alias("more"), F.bool_or("valid").alias("valid")).where("more AND NOT valid").select("folder")


def weekly_due(owners: DataFrame, weeklies: DataFrame) -> DataFrame:
    """(owner, run_day, due, start_day, end_day, cutover, capped) for owners (owner, run_day).

    Due are the whole weeks after the last summary, the oldest eight of them when there are more; without a summary the
    last whole week alone (cutover). When nothing is due, the period is the last summary's.
    """
    end = last_sunday(F.col("run_day"))
    since = F.date_add("done.end_day", 1)
    none, up = F.col("done.owner").isNull(), F.col("done.end_day") >= end
    capped = ~none & ~up & (F.date_diff(end, since) + 1 > WEEKS * 7)
    first = F.when(none, F.date_sub(end, 6)).when(up, F.col("done.start_day")).otherwise(since)
    last = F.when(~none & up, F.col("done.end_day")).when(capped, F.date_add(since, WEEKS * 7 - 1)).otherwise(end)
    met = owners.alias("o").join(checkpoints(weeklies).alias("done"), F.col("o.owner") == F.col("done.owner"), "left")
    return met.select("o.owner", "run_day", (none | ~up).alias("due"), first.alias("start_day"), last.alias("end_day"), none.alias("cutover"), F.coalesce(capped, F.lit(False)).alias("capped"))


def quarterly_due(owners: DataFrame, quarterlies: DataFrame) -> DataFrame:
    """(owner, run_day, due, start_day, end_day): the oldest whole quarter after the last summary; without one the last whole quarter."""
    this = F.date_trunc("quarter", F.col("run_day")).cast("date")
    completed = F.add_months(this, -3)
    none, up = F.col("done.owner").isNull(), F.col("done.start_day") >= completed
    first = F.when(none, completed).when(up, F.col("done.start_day")).otherwise(F.add_months(F.date_trunc("quarter", F.col("done.start_day")).cast("date"), 3))
    met = owners.alias("o").join(checkpoints(quarterlies).alias("done"), F.col("o.owner") == F.col("done.owner"), "left")
    return met.select("o.owner", "run_day", (none | ~up).alias("due"), first.alias("start_day"), F.date_sub(F.add_months(first, 3), 1).alias("end_day"))


def previous_inputs(owners: DataFrame, quarterly: bool = False) -> DataFrame:
    """(owner, start_day, end_day) of the plain rule without checkpoints: seven days up to the run's day, or the quarter before it."""
    this = F.date_trunc("quarter", F.col("run_day")).cast("date")
    first, last = (F.add_months(this, -3), F.date_sub(this, 1)) if quarterly else (F.date_sub("run_day", 6), F.col("run_day"))
    return owners.select("owner", first.alias("start_day"), last.alias("end_day"))


def daily_inputs(covers: DataFrame, due: DataFrame, represented: DataFrame | None = None) -> DataFrame:
    """(owner, day, path) for each day of each owner's due period: the owner's newest cover of that day, larger path on ties, null where none is.

    ``represented`` (owner, day) are days that need no daily. A cover is cut to its owner's due period before it is spread
    over days, so its own length costs nothing.
    """
    period = due.select("owner", F.col("start_day").alias("a"), F.col("end_day").alias("b"))
    days = period.select("owner", F.explode(F.sequence("a", "b")).alias("day"))
    if represented is not None:
        days = days.join(represented.select("owner", "day"), ["owner", "day"], "left_anti")
    met = covers.join(period, "owner").where("end_day >= a AND start_day <= b")
    spread = met.select("owner", "path", "stamp", F.explode(F.sequence(F.greatest("start_day", "a"), F.least("end_day", "b"))).alias("day"))
    best = spread.groupBy("owner", "day").agg(F.max_by("path", F.struct("stamp", "path")).alias("path"))
    return days.join(best, ["owner", "day"], "left")


def late_dailies(covers: DataFrame, weeklies: DataFrame, chosen: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, path, late): covers that meet a period summed up already but are in no summary's sources and not chosen now.

    Late are those that meet a summary which ends in the last eight weeks; the others are too old to be added. Covers and
    summaries meet on equal weeks; a cover is cut to the span of its owner's summaries first.
    """
    good = weeklies.where("valid").join(owners, "owner")
    recent = F.col("end_day") >= F.date_sub(last_sunday(F.col("run_day")), WEEKS * 7 - 1)
    weeks = good.select("owner", recent.alias("recent"), F.explode(F.expr("sequence(start_day, end_day, interval 7 days)")).alias("week"))
    weeks = weeks.groupBy("owner", "week").agg(F.max("recent").alias("recent"))
    span = good.groupBy("owner").agg(F.min("start_day").alias("a"), F.max("end_day").alias("b"))
    used = good.select("owner", F.explode("sources").alias("path")).unionByName(chosen.where("path IS NOT NULL").select("owner", "path"))
    left = covers.join(used, ["owner", "path"], "left_anti").join(span, "owner").where("end_day >= a AND start_day <= b")
    monday = F.date_trunc("week", F.greatest("start_day", "a")).cast("date")
    spread = left.select("owner", "path", F.explode(F.sequence(monday, F.least("end_day", "b"), F.expr("interval 7 days"))).alias("week"))
    return spread.join(weeks, ["owner", "week"]).groupBy("owner", "path").agg(F.max("recent").alias("late"))


def represented_days(weeklies: DataFrame, covers: DataFrame, due: DataFrame) -> DataFrame:
    """(owner, day) of due quarters that a weekly summary inside the quarter has taken in: days of the covers among its sources, not all its period.

    A source is the cover of that path, whoever owns it.
    """
    period = due.select("owner", F.col("start_day").alias("a"), F.col("end_day").alias("b"))
    inside = weeklies.where("valid").join(period, "owner").where("start_day >= a AND end_day <= b")
    listed = inside.select("owner", "a", "b", F.explode("sources").alias("path")).distinct()
    met = listed.join(covers.select("path", "start_day", "end_day"), "path").where("end_day >= a AND start_day <= b")
    return met.select("owner", F.explode(F.sequence(F.greatest("start_day", "a"), F.least("end_day", "b"))).alias("day")).distinct()
