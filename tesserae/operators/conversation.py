"""Message log operators: gates, exchanges, pairs, recency, duplicates, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recordable(messages: DataFrame) -> DataFrame:
    """Rows worth recording: not blank, no reply markers or connection tests, no long JSON from the assistant."""
    text = F.trim("content")
    json_blob = (F.col("role") == "assistant") & (F.length("content") > 200) & text.startswith("{") & text.endswith("}")
    return messages.where((F.length(text) > 0) & ~text.startswith("[NO_REPLY]") & (F.lower(text) != "connection test") & ~json_blob)


def without_repeats(messages: DataFrame) -> DataFrame:
    """Drops a row whose trimmed text equals that of the same user's and role's previous row."""
    w = Window.partitionBy("user_id", "role").orderBy("id")
    return messages.withColumn("__before", F.lag(F.trim("content")).over(w)).where(~F.trim("content").eqNullSafe(F.col("__before"))).drop("__before")


def exchanges(messages: DataFrame) -> DataFrame:
    """A user row and the rows after it in its session, up to the next user row; what precedes the first user row is dropped."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.where(F.col("role") != "system").withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(w)).where("exchange > 0")
    return rows.groupBy("session_id", "user_id", "exchange").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("n_messages"),
        F.max((F.col("role") != "user").cast("int")).alias("complete"),
        F.array_sort(F.collect_list("id")).alias("ids"),
    )


def settlement_exchanges(messages: DataFrame) -> DataFrame:
    """One open exchange per user across sessions: any user row closes it; responses join only from its own session."""
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.where(F.col("role") != "system").withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(w)).where("exchange > 0")
    opened = F.last(F.when(F.col("role") == "user", F.col("session_id")), ignorenulls=True).over(w)
    return rows.withColumn("open_session", opened).where("session_id = open_session").groupBy("user_id", "exchange").agg(F.count("*").alias("n_messages"), F.max("ts").alias("end_ts"))


def recent_pairs(messages: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them, if any; stray assistant turns are dropped."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = messages.withColumns({"__role": F.lead("role").over(w), "__content": F.lead("content").over(w)}).where("role = 'user'")
    return rows.select("id", "session_id", F.col("content").alias("question"), F.when(F.col("__role") == "assistant", F.col("__content")).alias("answer"))


def latest(messages: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The newest n rows, of all or of each key; ties by id."""
    if by is None:
        return messages.orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    return messages.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def since(messages: DataFrame, watermark: int, n: int = 30) -> DataFrame:
    """The first n rows after a watermark and all rows tied with the last of them; two bounded steps, no global window."""
    after = messages.where(F.col("ts") > watermark)
    last = after.orderBy("ts", "id").limit(n).agg(F.max("ts").alias("__last"))
    return after.join(F.broadcast(last), F.col("ts") <= F.col("__last")).drop("__last")


def sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("ts").alias("last_ts"))


def pending(messages: DataFrame) -> DataFrame:
    """Conditional counts by user: user and other rows, system-marked rows, last time."""
    return messages.groupBy("user_id").agg(
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_user"),
        F.sum(F.when(F.col("role") != "user", 1).otherwise(0)).alias("n_other"),
        F.max(F.when(F.col("role") != "system", F.col("ts"))).alias("last_ts"),
    )


def keyword_search(messages: DataFrame, words: list[str], every: bool = False, limit: int = 20) -> DataFrame:
    """Rows containing any (or every) word, ignoring ASCII case, newest first."""
    hits = [F.lower("content").contains(w.lower()) for w in words]
    test = hits[0]
    for h in hits[1:]:
        test = test & h if every else test | h
    return messages.where(test).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def substring_search(messages: DataFrame, words: list[str], normal: Column) -> DataFrame:
    """Share of the words (three letters or more) found in the normalised text; rows with any."""
    words = [w for w in words if len(w) >= 3]
    score = sum((normal.contains(w).cast("int") for w in words), F.lit(0)) / len(words)
    return messages.withColumn("score", score).where("score > 0")


def neighbours(messages: DataFrame) -> DataFrame:
    """Nearest strictly earlier and later row of the session; rows at the same time are neither."""
    w = Window.partitionBy("session_id").orderBy("ts")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    return messages.select("id", F.max_by("id", F.struct("ts", "id")).over(back).alias("previous_id"), F.min_by("id", F.struct("ts", "id")).over(ahead).alias("next_id"))


def advanced(watermarks: DataFrame, updates: DataFrame) -> DataFrame:
    """Monotonic watermark of each user."""
    return watermarks.unionByName(updates).groupBy("user_id").agg(F.max("ts").alias("ts"))


def fallback_summary(messages: DataFrame, lines: int = 30, chars: int = 100) -> DataFrame:
    """First user lines of each session, cut, joined."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = messages.where("role = 'user'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= lines)
    parts = F.array_sort(F.collect_list(F.struct("k", F.substring("content", 1, chars).alias("line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p.line), "\n").alias("summary"))
