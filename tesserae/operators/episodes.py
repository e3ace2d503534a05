"""Episodes: grouping by topic and gap, budgets, prominence, links, arcs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 60 * 60 * 1000


def islands(rows: DataFrame, key: str, order: list[Column], starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows within a key; ``starts`` says where a run begins."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__starts", F.coalesce(starts, F.lit(True)).cast("long")).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def topic_groups(rows: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """Runs of one user's rows with one topic, one session, and no gap above ``gap`` (a gap of exactly that keeps the run)."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    same = F.lag("topic").over(w).eqNullSafe(F.col("topic")) & F.lag("session_id").over(w).eqNullSafe(F.col("session_id"))
    starts = ~same | (F.col("ts") - F.lag("ts").over(w) > gap)
    return islands(rows, "user_id", [F.col("ts"), F.col("id")], starts, "grp")


def episodes(rows: DataFrame, gap: int = GAP_MS) -> DataFrame:
    grouped = topic_groups(rows, gap).groupBy("user_id", "grp")
    out = grouped.agg(F.first("topic").alias("topic"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return out.withColumn("grouping_hash", F.sha2(F.concat_ws(":", "user_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")), 256))


def linked(eps: DataFrame) -> DataFrame:
    """Each episode with the previous and next one of its user and topic."""
    w = Window.partitionBy("user_id", "topic").orderBy("start_ts", "grp")
    return eps.withColumns({"prev_grp": F.lag("grp").over(w), "next_grp": F.lead("grp").over(w)})


def overlapping(new: DataFrame, old: DataFrame) -> DataFrame:
    """New episodes that share a source message with an old one of the same user: by message, not by pair of arrays."""
    seen = old.select("user_id", F.explode("ids").alias("__id")).distinct()
    return new.select("user_id", "grp", F.explode("ids").alias("__id")).join(seen, ["user_id", "__id"], "left_semi").select("user_id", "grp").distinct()


def chunked(rows: DataFrame, budget: float, margin: float = 1.2) -> DataFrame:
    """Chunks of a user's rows by a running budget of estimated tokens that starts again at each overflow.

    The restart makes it no plain window; a user's rows go by in order, and only their sizes are read. What is kept between
    two rows is the budget used and the chunk, so the work grows with the rows and no list of them is made.
    """
    size = (F.ceil(F.length("content") / 4) * margin).cast("double")
    kind = rows.schema["user_id"].dataType.simpleString()
    listed = rows.select("user_id", F.col("id").cast("long").alias("id"), size.alias("size"), "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, chunk, begun = None, 0.0, 0, False
        for b in batches:
            chunks = []
            for user, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or user != now:
                    now, used, chunk, begun = user, 0.0, 0, True
                if used is None or z is None:  # a text of unknown size: nothing is known from there on
                    used = chunk = None
                elif used + z > budget and used > 0:
                    used, chunk = z, chunk + 1
                else:
                    used += z
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.int32())], names=["user_id", "id", "chunk"])

    return listed.select("user_id", "id", "size").mapInArrow(fold, f"user_id {kind}, id long, chunk int")


def decayed(prominence: Column, rate: float = 0.95) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), prominence * rate))


def arc(rows: DataFrame, key: str, valence: str) -> DataFrame:
    """Mean, population deviation, and the difference between the later and the earlier half of a key's rows."""
    w = Window.partitionBy(key)
    half = F.row_number().over(w.orderBy("ts", "id")) <= F.ceil(F.count("*").over(w) / 2)
    marked = rows.withColumn("__early", half)
    return marked.groupBy(key).agg(
        F.avg(valence).alias("mean"),
        F.stddev_pop(valence).alias("deviation"),
        F.coalesce(F.avg(F.when(~F.col("__early"), F.col(valence))) - F.avg(F.when(F.col("__early"), F.col(valence))), F.lit(0.0)).alias("trend"),
    )
