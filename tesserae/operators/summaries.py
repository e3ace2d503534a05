"""Summary files: which newer windows retire which older ones; filling a session's context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def superseded(files: DataFrame) -> DataFrame:
    """file_id of files that a later one of the same owner without holes contains.

    files: file_id, owner, start_day, end_day (dates, inclusive), written (long), holes (boolean). A window with holes
    retires nothing; one of an unknown owner, or without a period, neither retires nor is retired. Equal windows: the
    later one stays; of two written at once, the one with the larger id is later.

    A sweep, not pairs: a window that contains another one covers its first day, so windows meet on (owner, day); there
    they are passed from the latest end down, with the latest writing time so far, and a window goes if that is later
    than its own. Work grows with the days that windows cover.
    """
    good = files.where("owner IS NOT NULL AND start_day <= end_day")
    when = F.struct("written", "file_id")
    covers = good.where("NOT coalesce(holes, true)").select("owner", F.explode(F.sequence("start_day", "end_day")).alias("day"), "end_day", when.alias("by"), F.lit(None).cast(good.schema["file_id"].dataType).alias("file_id"))
    asked = good.select("owner", F.col("start_day").alias("day"), "end_day", when.alias("own"), "file_id")
    rows = covers.withColumn("own", F.lit(None).cast(asked.schema["own"].dataType)).unionByName(asked.withColumn("by", F.lit(None).cast(covers.schema["by"].dataType)))
    w = Window.partitionBy("owner", "day").orderBy(F.desc("end_day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("latest", F.max("by").over(w)).where("file_id IS NOT NULL AND latest > own").select("file_id")


#: Pairs that come first, the share of the window in per cent and its bound in characters, every how many summaries a weekly one comes, and every how many weekly places a quarterly one.
FIRST_PAIRS, SHARE, MOST_CHARS, WEEKLY_EVERY, QUARTERLY_EVERY = 8, 5, 50_000, 3, 6


def context_budget(window: int) -> int:
    return min(window * SHARE // 100, MOST_CHARS)


def summary_order(daily: int, weekly: int, quarterly: int) -> list[tuple[str, int]]:
    """In which order summaries come that many of which there are, the newest daily aside, which comes first anyway.

    Two daily ones, then a weekly place; each sixth weekly place is for a quarterly one. A weekly place without
    weekly ones takes a daily one. Where there is no daily one left, a weekly one steps in, then a quarterly one.
    """
    left = {"daily": [("daily", k) for k in range(daily - 1, 0, -1)], "weekly": [("weekly", k) for k in range(weekly - 1, -1, -1)], "quarterly": [("quarterly", k) for k in range(quarterly - 1, -1, -1)]}
    out, places, turn = [], 0, 0
    while any(left.values()):
        turn += 1
        wishes = ["daily", "weekly", "quarterly"]
        if turn % WEEKLY_EVERY == 0:
            places += 1
            wishes = ["quarterly"] * (places % QUARTERLY_EVERY == 0) + ["weekly"] + wishes
        out.append(next(left[w].pop() for w in wishes if left[w]))
    return out


def session_context(items: DataFrame, budget: int) -> DataFrame:
    """(session_id, kind, nr, place): what fills a session's context, in order.

    items: session_id, kind (pair, daily, weekly, quarterly), nr (0 is the newest of its kind, without gaps), size (characters,
    1 at least). First the eight newest pairs (a line break between two) and the newest daily summary, whatever
    their size; then rounds of the next pair and the next summary by ``summary_order``. The first item that does not fit, or
    that is missing, ends the context.

    The order follows from the numbers of items alone, so the fill is one running sum per session; items whose number is
    beyond the budget cannot come in and are left out before.
    """
    items = items.where(F.col("nr") <= budget + FIRST_PAIRS)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).alias(kind)
    counts = items.groupBy("session_id").agg(*map(count, ("pair", "daily", "weekly", "quarterly")))

    @F.pandas_udf("array<struct<kind:string,nr:int>>")
    def order(daily: pd.Series, weekly: pd.Series, quarterly: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "nr": n} for k, n in summary_order(*c)] for c in zip(daily, weekly, quarterly)])

    summaries = counts.select("session_id", F.posexplode(order("daily", "weekly", "quarterly")).alias("round", "s")).select("session_id", "round", "s.kind", "s.nr")
    ends = counts.select("session_id", (F.col("pair") - FIRST_PAIRS).alias("rounds"), (F.greatest(F.col("daily") - 1, F.lit(0)) + F.col("weekly") + F.col("quarterly")).alias("others"))
    pairs = items.where("kind = 'pair'").join(ends, "session_id")
    floor = pairs.where(F.col("nr") < FIRST_PAIRS).select("session_id", "kind", "nr", F.col("nr").alias("place"), (F.col("size") + F.when(F.col("nr") > 0, 1).otherwise(0)).alias("size"))
    newest = items.where("kind = 'daily' AND nr = 0").select("session_id", "kind", "nr", F.lit(FIRST_PAIRS).alias("place"), "size")
    # A pair comes as long as the summaries of all rounds before it were there, a summary only after its round's pair.
    more = pairs.where((F.col("nr") >= FIRST_PAIRS) & (F.col("nr") - FIRST_PAIRS <= F.col("others"))).select("session_id", "kind", "nr", (2 * F.col("nr") - FIRST_PAIRS + 1).alias("place"), "size")
    rest = summaries.join(ends, "session_id").where("round < rounds").join(items, ["session_id", "kind", "nr"]).select("session_id", "kind", "nr", (2 * F.col("round") + FIRST_PAIRS + 2).alias("place"), "size")
    placed = floor.unionByName(newest).unionByName(more).unionByName(rest)
    w = Window.partitionBy("session_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sizes are positive, so the sum never falls: what fits is the beginning.
    return placed.withColumn("used", F.sum("size").over(w)).where((F.col("place") <= FIRST_PAIRS) | (F.col("used") <= budget)).select("session_id", "kind", "nr", "place")
