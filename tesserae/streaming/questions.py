"""The life of questions about pairs of memories, as a stateful stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..ship import shipped

#: Milliseconds of a question's life, of the time after asking or dismissing in which a pair is not asked again, of the time that closed ones are kept; open questions of an owner.
DAY = 24 * 3600 * 1000
LIFE, PAUSE, KEPT, MOST_OPEN = 7 * DAY, 7 * DAY, 30 * DAY, 20
OPEN = ("pending", "asked")
OUT = "owner string, question_id long, outcome string, at long"
_ROW = "id long, status string, asked long, dismissed long, expires long, closed long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Questions(StatefulProcessor):
    """One owner's questions: the newest of each pair, with when the pair was last asked and dismissed.

    The owner's rows are read once a call and those that changed are written once at its end, with a timer for each as it then stands.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "pair string", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ids, pairs, kinds, names = _in_order(rows)
        book = _Book(self.rows)
        out = []
        for now, event, pair, kind in zip(at, ids, pairs, kinds, strict=True):
            book.expire(key[0], int(now), out)
            pair, kind = names[pair], names[kind]
            if kind == "candidate":
                out.append((key[0], int(event), book.offered(pair, int(event), int(now)), int(now)))
            else:
                i, outcome = book.changed(pair, kind, int(now))
                out.append((key[0], i, outcome, int(now)))
            if len(out) >= BLOCK:
                yield _frame(out)
                out = []
        book.save(self.rows, self.handle)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        book, out = _Book(self.rows), []
        book.expire(key[0], now, out)
        book.save(self.rows, self.handle)
        for k, v in book.rows.items():
            if v[1] not in OPEN and v[5] is not None and v[5] + KEPT <= now:
                self.rows.removeKey((k,))
        yield _frame(out)

    def close(self) -> None:
        pass


class _Book:
    """Rows of an owner (pair: id, status, asked, dismissed, expires, closed), the open ones apart: there are few."""

    def __init__(self, state) -> None:
        self.rows = {k[0]: tuple(v) for k, v in state.iterator()}
        self.open = {pair: v[4] for pair, v in self.rows.items() if v[1] in OPEN}
        self.touched: set[str] = set()

    def _put(self, pair: str, row: tuple) -> None:
        self.rows[pair] = row
        self.touched.add(pair)
        if row[1] in OPEN:
            self.open[pair] = row[4]
        else:
            self.open.pop(pair, None)

    def expire(self, owner: str, now: int, out: list[tuple]) -> None:
        """Open questions whose time is over at ``now`` are closed."""
        due = [pair for pair, expires in self.open.items() if expires <= now]
        found = []
        for pair in due:
            i, _, asked, dismissed, expires, _ = self.rows[pair]
            self._put(pair, (i, "expired", asked, dismissed, expires, expires))
            found.append((owner, i, "expired", expires))
        out += sorted(found, key=lambda r: (r[3], r[1]))

    def offered(self, pair: str, i: int, now: int) -> str:
        if pair in self.open:
            return "active_pair"
        known = self.rows.get(pair)
        asked, dismissed = (known[2] or 0, known[3] or 0) if known else (0, 0)
        if max(asked, dismissed) > 0 and now - max(asked, dismissed) < PAUSE:
            return "recent"
        if len(self.open) >= MOST_OPEN:
            return "cap"
        self._put(pair, (i, "pending", asked, dismissed, now + LIFE, None))
        return "accepted"

    def changed(self, pair: str, kind: str, now: int) -> tuple[int | None, str]:
        if pair not in self.open:
            return None, "ignored"
        i, _, asked, dismissed, expires, _ = self.rows[pair]
        asked, dismissed = (now, dismissed) if kind == "asked" else (asked, now) if kind == "dismissed" else (asked, dismissed)
        self._put(pair, (i, kind, asked, dismissed, expires, None if kind == "asked" else now))
        return i, kind

    def save(self, state, handle: StatefulProcessorHandle) -> None:
        for pair in sorted(self.touched):
            row = self.rows[pair]
            state.updateValue((pair,), row)
        for moment in {self.rows[p][4] if self.rows[p][1] in OPEN else self.rows[p][5] + KEPT for p in self.touched}:
            handle.registerTimer(moment)


#: Rows of an answer that are handed over at once.
BLOCK = 20_000


def _in_order(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """at, event_id, pair and kind (as numbers into the last part) by time and id: 24 bytes an event, whatever its texts."""
    numbers: dict = {}
    parts = []
    for chunk in rows:
        coded = [np.fromiter((numbers.setdefault(None if pd.isna(v) else v, len(numbers)) for v in chunk[c]), np.int32, len(chunk)) for c in ("pair", "kind")]
        parts.append((chunk["at"].to_numpy(np.int64), chunk["event_id"].to_numpy(np.int64), *coded))
    at, ids, pairs, kinds = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, at))
    return at[order], ids[order], pairs[order], kinds[order], list(numbers)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate((("owner", "object"), ("question_id", "Int64"), ("outcome", "object"), ("at", "int64")))})


def lifecycle(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(owner, question_id, outcome, at) of events (ts, event_id, owner, pair, kind), kind one of candidate, asked, dismissed, resolved.

    A candidate becomes a question (its id is the event's) unless its pair has an open one (``active_pair``), was asked or
    dismissed in the last seven days (``recent``), or the owner has twenty open ones (``cap``). A question that is not closed
    within seven days is ``expired``: when the owner's next event comes, or by a timer when the watermark gets there. What is
    closed goes after 30 days, so an owner's state does not grow with time. Other kinds change the pair's open question, or
    are ``ignored``. The cap is the owner's: one of all owners would put all questions into one task.
    """
    shipped(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("owner IS NOT NULL").withWatermark("ts", late).select("ts", "event_id", "owner", "pair", "kind", F.unix_millis("ts").alias("at"))
    return rows.groupBy("owner").transformWithStateInPandas(statefulProcessor=Questions(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
