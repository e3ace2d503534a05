"""Run keeping: receipts, verdicts, health, questions, review parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def receipts_by_disposition(receipts: DataFrame, kinds: list[str]) -> DataFrame:
    return receipts.groupBy("run_id").agg(*(F.count_if(F.col("disposition") == k).alias(k) for k in kinds))


def unhandled(shown: DataFrame, receipts: DataFrame, most: int = 10) -> DataFrame:
    return shown.join(receipts.where("disposition <> 'rejected'").select("item_id"), "item_id", "left_anti").orderBy("item_id").limit(most)


def verdict(ok: Column, repaired: Column, reviewed: Column, blocked: Column, asked: Column) -> Column:
    """accepted, repaired, partial, blocked or unreviewed; a model's verdict may only lower the computed one."""
    order = F.create_map(*[F.lit(x) for pair in {"accepted": 0, "repaired": 1, "partial": 2, "blocked": 3, "unreviewed": 4}.items() for x in pair])
    own = F.when(blocked, "blocked").when(~reviewed, "unreviewed").when(ok & repaired, "repaired").when(ok, "accepted").otherwise("partial")
    return F.when(order[asked] > order[own], asked).otherwise(own)


def health(last_sleep: Column, failures: Column, last_daily: Column, last_backup: Column, now: int) -> Column:
    """Warnings by fixed thresholds: 48 hours, 3 failures, 3 days, 7 days."""
    checks = [(now - last_sleep > 2 * DAY, "sleep"), (failures > 3, "failures"), (now - last_daily > 3 * DAY, "daily"), (now - last_backup > 7 * DAY, "backup")]
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in checks)), lambda x: x.isNotNull()), ",")


def first_matches(text: Column, keys: dict[str, str]) -> list[Column]:
    """One number per key: the first match of its pattern, else 0."""
    return [F.coalesce(F.regexp_extract(text, p, 1).try_cast("bigint"), F.lit(0)).alias(k) for k, p in keys.items()]


def parsed_sections(text: Column) -> Column:
    """array<struct<kind, text>> of "[kind] text" lines between ===MEMORIES=== and ===END===."""
    body = F.regexp_extract(text, r"(?s)===MEMORIES===(.*?)===END===", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*\[\w+\]\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*\[(\w+)\]", 1).alias("kind"), F.trim(F.regexp_extract(x, r"^\s*\[\w+\]\s+(.*)$", 1)).alias("text")))


def question(text: Column) -> Column:
    """A normalised question of 20 to 300 letters with a question mark, else null."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain).between(20, 300) & plain.contains("?"), plain)


def question_states(questions: DataFrame, now: int) -> DataFrame:
    """Resolved before expired; terminal rows older than 30 days are dropped."""
    state = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("dismissed_at").isNotNull(), "dismissed").when(F.col("expires_at") <= now, "expired").otherwise(F.col("status"))
    end = F.coalesce("resolved_at", "dismissed_at", "expires_at")
    out = questions.withColumn("state", state)
    return out.where(F.col("state").isin("pending", "asked") | (end > now - 30 * DAY))


def edited_once(text: Column, old: Column, new: Column, expected: Column) -> Column:
    """The text with the one paragraph that equals ``old`` replaced, if exactly one does and the text's hash starts as expected; else null."""
    parts = F.split(text, "\n\n")
    hits = F.size(F.filter(parts, lambda p: p == old))
    return F.when((hits == 1) & F.sha2(text, 256).startswith(F.substring(expected, 1, 12)), F.array_join(F.transform(parts, lambda p: F.when(p == old, new).otherwise(p)), "\n\n"))


def appended(before: Column, after: Column) -> Column:
    return after.startswith(before) & (F.length(after) > F.length(before)) & (F.length(F.trim(F.expr("substring(after, length(before) + 1)"))) > 0)


def reconciled(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Whether claimed count, last time and scopes equal those of the rows."""
    real = actual.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.array_join(F.sort_array(F.collect_set("scope")), ",").alias("scopes"))
    c = claimed.select("user_id", F.col("n").alias("cn"), F.col("last_ts").alias("cl"), F.col("scopes").alias("cs"))
    return c.join(real, "user_id", "left").select("user_id", (F.col("cn").eqNullSafe(F.col("n")) & F.col("cl").eqNullSafe(F.col("last_ts")) & F.col("cs").eqNullSafe(F.col("scopes"))).alias("agrees"))


def eligible_steps(steps: DataFrame, level: str, gates: dict[str, bool]) -> DataFrame:
    """Steps (name, level, requires) of the level, or of level:curation, whose gates are open; an unknown gate is open."""
    open_gates = F.create_map(*[F.lit(x) for pair in gates.items() for x in pair]) if gates else F.expr("cast(map() as map<string,boolean>)")
    wanted = F.col("level").isin(level, f"{level}:curation")
    return steps.where(wanted & F.forall("requires", lambda g: F.coalesce(open_gates[g], F.lit(True))))


def failed_essentials(essential: DataFrame, results: DataFrame) -> DataFrame:
    met = essential.join(results, "name", "left")
    return met.where(F.col("status").isNull() | F.col("status").isin("failed", "timeout", "pending")).select("name", F.coalesce("status", F.lit("missing")).alias("status"))


def proposal(line: Column) -> Column:
    """VERB key="value" ...: verb and map of values, null for another shape."""
    pairs = F.regexp_extract_all(line, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("k"), F.regexp_replace(F.regexp_extract(p, r'(?s)^\w+="(.*)"$', 1), r"\\(.)", "$1").alias("v")))
    verb = F.regexp_extract(line, r"^\s*([A-Z]+)\b", 1)
    return F.when((F.length(verb) > 0) & (F.size(pairs) > 0) & (F.size(F.array_distinct(F.transform(entries, lambda e: e.k))) == F.size(entries)), F.struct(verb.alias("verb"), F.map_from_entries(entries).alias("fields")))


def last_lines(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def last_change(questions: DataFrame, keys: list[str], *times: str) -> DataFrame:
    """Per key, the latest of several times that may be null (column ``latest``); 0 where none is known."""
    return questions.groupBy(*keys).agg(F.greatest(F.lit(0), *(F.coalesce(F.max(t), F.lit(0)) for t in times)).cast("bigint").alias("latest"))
