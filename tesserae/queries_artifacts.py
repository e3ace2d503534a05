"""Queries over summary files: days and weeks of the events, published as files of three tiers, read by their heads; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cadence as K
from .queries import query
from .shared import exists, new_folder, written
from .sources import artifacts as A
from .sources.tables import table

# Dailies of a user's days, some without a day, an owner or a heading; weeklies and quarterlies, some with a wrong period or another owner.
FILES_SQL = """ev AS (SELECT DISTINCT user_id AS u, ts::DATE AS d, day(ts) AS m FROM events WHERE user_id IS NOT NULL),
ow AS (SELECT DISTINCT u, 'u' || u AS owner, CASE WHEN u % 3 = 0 THEN DATE '2024-04-10' ELSE DATE '2024-02-07' END AS run_day, CASE WHEN u % 3 = 0 THEN DATE '2024-04-07' ELSE DATE '2024-02-04' END AS sunday FROM ev),
dl AS (SELECT u, d AS a, CASE WHEN m % 9 <> 0 AND m % 4 = 0 THEN d + 1 ELSE d END AS b, m, CASE WHEN m % 11 = 0 THEN NULL WHEN m % 13 = 0 THEN 'u' || (u + 1) ELSE 'u' || u END AS owner,
CASE WHEN m % 9 = 0 THEN epoch_ms(d::TIMESTAMP) ELSE epoch_ms((d + 1)::TIMESTAMP) + 10800000 + u % 60 * 60000 END AS stamp,
'u' || u || '/daily/daily_' || CASE WHEN m % 9 = 0 THEN d::VARCHAR ELSE (d + 1)::VARCHAR || '-03' || lpad((u % 60)::VARCHAR, 2, '0') || 'Z' END || '.md' AS path FROM ev WHERE (u + m) % 7 <> 0),
wa AS (SELECT u, w AS a, w + 6 AS b, 'u' || u || '/weekly/weekly_' || w::VARCHAR || '_' || (w + 6)::VARCHAR || '.md' AS path, (u + (w - DATE '2024-01-01') // 7) % 6 AS r FROM (SELECT DISTINCT u, date_trunc('week', d)::DATE AS w FROM ev) WHERE w < DATE '2024-01-01' + (7 * (u % 5))::INT),
wk AS (SELECT *, CASE WHEN r = 1 THEN 'u' || (u + 1) ELSE 'u' || u END AS owner FROM wa WHERE r <> 0),
sr AS (SELECT wk.path AS weekly, wk.owner, wk.a, wk.b, dl.path, dl.a AS c, dl.b AS e FROM wk JOIN dl ON dl.u = wk.u AND dl.a BETWEEN wk.a AND wk.b AND dl.m % 6 <> 1),
qu AS (SELECT owner, DATE '2023-07-01' AS a FROM ow WHERE u % 4 IN (1, 3) UNION ALL SELECT owner, DATE '2023-10-01' FROM ow WHERE u % 4 = 2),
cw AS (SELECT owner, max_by({a: a, b: b}, b) AS z FROM wk GROUP BY 1),
dw AS (SELECT owner, u, run_day, sunday, z IS NULL OR z.b < sunday AS due, CASE WHEN z IS NULL THEN sunday - 6 WHEN z.b >= sunday THEN z.a ELSE z.b + 1 END AS a,
CASE WHEN z IS NULL THEN sunday WHEN z.b >= sunday THEN z.b ELSE least(z.b + 56, sunday) END AS b, z IS NULL AS cutover, z IS NOT NULL AND z.b + 56 < sunday AS capped FROM ow LEFT JOIN cw USING (owner)),
dq AS (SELECT owner, q IS NULL OR q < c AS due, CASE WHEN q IS NULL THEN c WHEN q >= c THEN q ELSE (q + INTERVAL 3 MONTH)::DATE END AS a FROM (SELECT owner, (date_trunc('quarter', run_day) - INTERVAL 3 MONTH)::DATE AS c FROM ow) LEFT JOIN (SELECT owner, max(a) AS q FROM qu GROUP BY 1) USING (owner)),
pq AS (SELECT *, (a + INTERVAL 3 MONTH)::DATE - 1 AS b FROM dq)"""


def _owners(s, d):
    u = F.col("user_id")
    run = F.to_date(F.when(u % 3 == 0, F.lit("2024-04-10")).otherwise("2024-02-07"))
    return table(s, d, "events").where("user_id IS NOT NULL").select(F.concat(F.lit("u"), u).alias("owner"), run.alias("run_day")).distinct()


def _files(s, d):
    """(path, text) of all files; the text of a daily lists the day's events."""
    u, day = F.col("u"), F.col("d")
    m = F.dayofmonth(day)
    own, other = F.concat(F.lit("u"), u), F.concat(F.lit("u"), u + 1)
    ev = table(s, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("u"), F.to_date("ts").alias("d"), "event_id", "event_type")
    body = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "event_id", "event_type"))), "\n")
    days = ev.groupBy("u", "d").agg(body.alias("body")).where((u + m) % 7 != 0)
    name = F.when(m % 9 == 0, day.cast("string")).otherwise(F.concat(F.date_add(day, 1).cast("string"), F.lit("-03"), F.lpad((u % 60).cast("string"), 2, "0"), F.lit("Z")))
    owner = F.when(m % 11 == 0, F.lit("")).when(m % 13 == 0, F.concat(F.lit("Owner: "), other, F.lit("\n"))).otherwise(F.concat(F.lit("Owner: "), own, F.lit("\n")))
    title = F.when(m % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("# Daily Summary "), day.cast("string"), F.when(m % 4 == 0, F.concat(F.lit(" — "), F.date_add(day, 1).cast("string"))).otherwise(""), F.lit("\n")))
    daily = days.select("u", "d", F.concat(own, F.lit("/daily/daily_"), name, F.lit(".md")).alias("path"), F.concat(title, owner, F.lit("\n"), "body").alias("text"))

    week = F.date_trunc("week", day).cast("date")
    used = F.array_join(F.sort_array(F.collect_list(F.when(m % 6 != 1, F.col("path")))), ", ")
    first = F.to_date(F.lit("2024-01-01"))
    weeks = ev.select("u", week.alias("w")).distinct().where(F.col("w") < F.date_add(first, (u % 5 * 7).cast("int")))
    weeks = weeks.join(daily.groupBy("u", week.alias("w")).agg(used.alias("sources")), ["u", "w"], "left")
    r, last = (u + F.floor(F.date_diff("w", first) / 7)) % 6, F.date_add("w", 6)
    head = lambda o, a, b, listed: F.concat(F.lit("Owner: "), o, F.lit("\nPeriod-Start: "), a.cast("string"), F.lit("\nPeriod-End: "), b.cast("string"), F.lit("\nSources: "), listed, F.lit("\nCovered: all\n\n"))
    weekly = weeks.select(
        F.concat(own, F.lit("/weekly/weekly_"), F.col("w").cast("string"), F.lit("_"), last.cast("string"), F.lit(".md")).alias("path"),
        head(F.when(r == 1, other).otherwise(own), F.col("w"), F.when(r == 0, F.date_sub(last, 1)).otherwise(last), F.coalesce("sources", F.lit(""))).alias("text"),
    )
    quarters = F.when(u % 4 == 1, F.array(F.lit("Q3"))).when(u % 4 == 2, F.array(F.lit("Q4"))).when(u % 4 == 3, F.array(F.lit("Q3"), F.lit("Q4")))
    q = ev.select("u").distinct().select("u", F.explode(quarters).alias("q"))
    since = F.to_date(F.when(F.col("q") == "Q3", F.lit("2023-07-01")).otherwise("2023-10-01"))
    until = F.to_date(F.when(F.col("q") == "Q3", F.lit("2023-09-30")).when(u % 4 == 3, F.lit("2023-12-30")).otherwise("2023-12-31"))
    quarterly = q.select(F.concat(own, F.lit("/quarterly/quarterly_2023-"), "q", F.lit(".md")).alias("path"), head(own, since, until, F.lit("")).alias("text"))
    return daily.select("path", "text").unionByName(weekly).unionByName(quarterly)


def _root(s, d):
    """The folder of the files: written once for a session and folder of tables."""
    made = s.sparkContext.__dict__.setdefault("_tesserae_artifacts", {})
    if d not in made or not exists(s, made[d]):
        root = new_folder(s, "artifacts")
        A.publish(_files(s, d), root)
        made[d] = root
    return made[d]


def _covers(s, d):
    return written(A.daily_covers(A.heads(s, _root(s, d), "daily")))


def _tier(s, d, tier, **scan):
    return written(A.tier_artifacts(A.heads(s, _root(s, d), tier, **scan), tier))


@query(f"WITH {FILES_SQL} SELECT path, owner, a AS start_day, b AS end_day, stamp FROM dl")
def daily_file_covers(s, d):
    return _covers(s, d)


@query(f"""WITH {FILES_SQL} SELECT wa.path, wk.owner, wk.a AS start_day, wk.b AS end_day, CASE WHEN wk.path IS NOT NULL THEN (SELECT count(*) FROM sr WHERE weekly = wk.path) END AS n_sources
FROM wa LEFT JOIN wk USING (path) WHERE wa.a <= DATE '2024-01-10' AND wa.b >= DATE '2024-01-09' OR wa.a <= DATE '2024-01-23' AND wa.b >= DATE '2024-01-22'""")
def weekly_files_in_ranges(s, d):
    """Files whose names lie outside the ranges are not opened."""
    found = _tier(s, d, "weekly", ranges=[("2024-01-09", "2024-01-10"), ("2024-01-22", "2024-01-23")])
    return found.select("path", "owner", "start_day", "end_day", F.when(F.col("valid"), F.size("sources").cast("bigint")).alias("n_sources"))


@query(f"""WITH {FILES_SQL} SELECT owner, 'weekly' AS tier, due, a AS start_day, b AS end_day, cutover, capped FROM dw
UNION ALL SELECT owner, 'quarterly', due, a, b, NULL, NULL FROM pq""")
def consolidations_due(s, d):
    """By the newest eight names of each folder."""
    owners = _owners(s, d)
    weekly = K.weekly_due(owners, _tier(s, d, "weekly", newest=K.WEEKS)).withColumn("tier", F.lit("weekly"))
    quarterly = K.quarterly_due(owners, _tier(s, d, "quarterly", newest=K.WEEKS)).withColumn("tier", F.lit("quarterly"))
    return weekly.unionByName(quarterly, allowMissingColumns=True).drop("run_day")


CHOSEN_SQL = "ch AS (SELECT dw.owner, t.day::DATE AS day, max_by(dl.path, (dl.stamp, dl.path)) AS path FROM dw, unnest(generate_series(dw.a, dw.b, INTERVAL 1 DAY)) t(day) LEFT JOIN dl ON dl.owner = dw.owner AND t.day::DATE BETWEEN dl.a AND dl.b WHERE dw.due GROUP BY 1, 2)"


@query(f"""WITH {FILES_SQL}, {CHOSEN_SQL}, us AS (SELECT owner, path FROM sr UNION SELECT owner, path FROM ch WHERE path IS NOT NULL)
SELECT owner, day, path, 'due' AS kind FROM ch UNION ALL SELECT dl.owner, NULL, dl.path, CASE WHEN max(wk.b >= sunday - 55) THEN 'late' ELSE 'too old' END FROM dl JOIN ow USING (owner) JOIN wk ON wk.owner = dl.owner AND dl.b >= wk.a AND dl.a <= wk.b
WHERE (dl.owner, dl.path) NOT IN (SELECT owner, path FROM us) GROUP BY dl.owner, dl.path""")
def weekly_inputs(s, d):
    """Days of the due weeks with their files, and files that came after their week was summed up."""
    owners, covers, weeklies = _owners(s, d), _covers(s, d), _tier(s, d, "weekly")
    due = K.weekly_due(owners, weeklies).where("due")
    chosen = K.daily_inputs(covers, due)
    late = K.late_dailies(covers, weeklies, chosen, owners).select("owner", "path", F.when(F.col("late"), "late").otherwise("too old").alias("kind"))
    return chosen.withColumn("kind", F.lit("due")).unionByName(late, allowMissingColumns=True)


@query(f"""WITH {FILES_SQL}, re AS (SELECT DISTINCT sr.owner, t.day::DATE AS day FROM sr JOIN pq ON pq.owner = sr.owner AND pq.due AND sr.a >= pq.a AND sr.b <= pq.b, unnest(generate_series(greatest(sr.c, pq.a), least(sr.e, pq.b), INTERVAL 1 DAY)) t(day)),
dd AS (SELECT pq.owner, t.day::DATE AS day FROM pq, unnest(generate_series(a, b, INTERVAL 1 DAY)) t(day) WHERE due)
SELECT dd.owner, dd.day, max_by(dl.path, (dl.stamp, dl.path)) AS path FROM dd LEFT JOIN dl ON dl.owner = dd.owner AND dd.day BETWEEN dl.a AND dl.b WHERE (dd.owner, dd.day) NOT IN (SELECT owner, day FROM re) GROUP BY 1, 2""")
def quarterly_inputs(s, d):
    """Days of the due quarter that no weekly summary inside it has taken in, with their files; null where none is."""
    covers = _covers(s, d)
    due = K.quarterly_due(_owners(s, d), _tier(s, d, "quarterly")).where("due")
    return K.daily_inputs(covers, due, K.represented_days(_tier(s, d, "weekly"), covers, due))


@query(f"""WITH {FILES_SQL}, dd AS (SELECT owner, 'weekly' AS tier, unnest(generate_series(run_day - 6, run_day, INTERVAL 1 DAY))::DATE AS day FROM ow UNION ALL
SELECT owner, 'quarterly', unnest(generate_series((date_trunc('quarter', run_day) - INTERVAL 3 MONTH)::DATE, date_trunc('quarter', run_day)::DATE - 1, INTERVAL 1 DAY))::DATE FROM ow)
SELECT dd.owner, dd.tier, dd.day, max_by(dl.path, (dl.stamp, dl.path)) AS path FROM dd LEFT JOIN dl ON dl.owner = dd.owner AND dd.day BETWEEN dl.a AND dl.b GROUP BY 1, 2, 3""")
def previous_period_inputs(s, d):
    """The rule without checkpoints: seven days up to the run, and the quarter before it."""
    owners, covers = _owners(s, d), _covers(s, d)
    tiers = {t: K.daily_inputs(covers, K.previous_inputs(owners, t == "quarterly")).withColumn("tier", F.lit(t)) for t in ("weekly", "quarterly")}
    return tiers["weekly"].unionByName(tiers["quarterly"])
