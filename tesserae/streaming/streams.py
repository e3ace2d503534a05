"""Structured Streaming forms: sessions, time-bounded duplicates, watermarks, late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def event_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user by gap; keys of topic changes belong to the batch form."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n"), F.max("value").alias("top")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "top")


def first_seen(events: DataFrame, keys: list[str], ttl: str = "60 seconds") -> DataFrame:
    """Each key once within its time to live: nonces, repeated notices."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, size: str = "7 days", late: str = "56 days") -> DataFrame:
    """Weeks from Monday; rows later than the lateness are not added."""
    w = F.window("ts", size, startTime="4 days")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("week"), "event_type", "n", "total")


def late_rows(events: DataFrame, path: str, size: str = "7 days", late: str = "56 days", start: str = "4 days") -> DataFrame:
    """Rows that ``tumbling`` with the same size and lateness refuses, in append mode: those whose window has ended before the watermark of the trigger.

    Spark drops such rows without a trace. The watermark that a trigger refuses rows by comes from the largest time
    of the triggers before the last one; each trigger notes its own largest time under ``path``, in a folder of
    its own that a repeated trigger overwrites, so the rule is the same here and after a restart. The result is the table of
    what was refused, read back after the stream has ended.
    """
    spark = events.sparkSession
    marks = f"{path.rstrip('/')}/marks"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")
        top = None
        if batch >= 2:
            before = spark.read.parquet(*(f"{marks}/batch={b}" for b in range(batch - 1)))
            top = before.agg(F.max("top")).first()[0]
        refused = rows.limit(0) if top is None else rows.where(F.window("ts", size, startTime=start)["end"] <= F.lit(top) - F.expr(f"INTERVAL {late}"))
        refused.write.mode("overwrite").parquet(f"{path.rstrip('/')}/rows/batch={batch}")

    q = events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(events.schema).option("basePath", f"{path.rstrip('/')}/rows").parquet(f"{path.rstrip('/')}/rows")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result table (tests, backfills).

    Each trigger's rows are written as Parquet under ``spark.checkpoint.dir``, beside the
    stream's checkpoint, and a trigger that is repeated overwrites its own folder. With the
    mode complete the last trigger's folder is the result, else all of them are.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    seen: set[int] = set()

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        seen.add(batch)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(seen)] if mode == "complete" else sorted(seen)
    return spark.read.schema(stream.schema).parquet(*(f"{base}/rows/batch={b}" for b in wanted))
