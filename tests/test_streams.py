"""Streams over several triggers: late rows, states that shrink, question timers."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import questions as Q
from tesserae.streaming import streams as S

T0 = datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    """One file a batch, in order of their times."""
    import os

    for k, rows in enumerate(batches):
        path = f"{folder}/part-{k:03d}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


SCHEMA = "ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def weekly(spark, tmp_path):
    rng = random.Random(3)
    batches = []
    for k in range(8):
        now = T0 + timedelta(days=30 * k)
        rows = [(now + timedelta(days=rng.random() * 25), rng.randrange(4), "a", 1.0) for _ in range(40)]
        rows += [(now - timedelta(days=rng.randrange(1, 200)), 1, "b", 1.0) for _ in range(12 if k else 0)]
        batches.append(rows)
    (tmp_path / "in").mkdir()
    return files(spark, tmp_path / "in", batches, SCHEMA), [r for b in batches for r in b]


def test_weeks_and_late_rows_add_up(spark, weekly, tmp_path):
    path, rows = weekly
    stream = lambda: S.event_stream(spark, path, SCHEMA)
    weeks = S.drained(S.tumbling(stream())).collect()
    late = S.late_rows(stream(), str(tmp_path / "late")).collect()
    assert 0 < len(late) < len(rows)
    done = {(w.week, w.event_type): w.n for w in weeks}
    assert len(done) == len(weeks)  # each week once: append mode
    spark_week = {r.ts: r.week for r in spark.createDataFrame([(r[0],) for r in rows], "ts timestamp").select("ts", F.window("ts", "7 days", startTime="4 days")["start"].alias("week")).collect()}
    want = Counter((spark_week[ts], kind) for ts, _, kind, _ in rows)
    want -= Counter((spark_week[r.ts], r.event_type) for r in late)
    # every week that has ended before the last watermark is there, with all its rows but the late ones
    last = max(r[0] for r in rows) - timedelta(days=56)
    assert done == {k: n for k, n in want.items() if k[0] + timedelta(days=7) <= last}


def test_state_shrinks(spark, weekly, tmp_path):
    path, rows = weekly
    progress = []
    q = S.tumbling(S.event_stream(spark, path, SCHEMA)).writeStream.outputMode("append").foreachBatch(lambda df, b: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    every = {(r[0] - T0).days // 7 for r in rows}
    assert max(progress) < 2 * 20 and progress[-1] < len(every)


def test_sessions_in_append_mode(spark, tmp_path):
    batches = [[(T0 + timedelta(hours=h), 1, "a", 1.0) for h in hours] for hours in ([0, 0.5, 5], [5.5, 50], [100, 0.2])]
    (tmp_path / "in").mkdir()
    path = files(spark, tmp_path / "in", batches, SCHEMA)
    got = sorted((r.start, r.n) for r in S.drained(S.sessions(S.event_stream(spark, path, SCHEMA), "60 minutes", "2 hours")).collect())
    assert got == [(T0, 2), (T0 + timedelta(hours=5), 2), (T0 + timedelta(hours=50), 1)]  # the last one is open, the last row is late


def test_first_seen_forgets(spark, tmp_path):
    batches = [[(T0 + timedelta(seconds=t), 1, "a", 1.0) for t in ts] for ts in ([0, 5], [30, 400], [410, 1000], [1001])]
    (tmp_path / "in").mkdir()
    path = files(spark, tmp_path / "in", batches, SCHEMA)
    got = sorted((r.ts - T0).total_seconds() for r in S.drained(S.first_seen(S.event_stream(spark, path, SCHEMA), ["user_id"], "60 seconds")).collect())
    # 400 and 1000 come in triggers that still hold the state of the one before; 1001 comes after it was dropped.
    assert got == [0, 1001]


EVENTS = "ts timestamp, event_id long, owner string, pair string, kind string"


def plain_lifecycle(events, late_ms, cap):
    """One event after the other; what expires without one does so by the last watermark."""
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    out, owners = [], {}
    for ts, i, owner, pair, kind in sorted(events):
        rows, now = owners.setdefault(owner, {}), ms(ts)
        expire(out, owner, rows, now)
        row = rows.get(pair)
        if kind == "candidate":
            recent = max(row["asked"], row["dismissed"]) if row else 0
            if row and row["open"]:
                out.append((owner, i, "active_pair", now))
            elif recent and now - recent < Q.PAUSE:
                out.append((owner, i, "recent", now))
            elif sum(r["open"] for r in rows.values()) >= cap:
                out.append((owner, i, "cap", now))
            else:
                rows[pair] = {"id": i, "open": True, "asked": row["asked"] if row else 0, "dismissed": row["dismissed"] if row else 0, "expires": now + Q.LIFE}
                out.append((owner, i, "accepted", now))
        elif not row or not row["open"]:
            out.append((owner, None, "ignored", now))
        else:
            row["open"] = kind == "asked"
            if kind in row:
                row[kind] = now
            out.append((owner, row["id"], kind, now))
    for owner, rows in owners.items():
        expire(out, owner, rows, max(ms(e[0]) for e in events) - late_ms)
    return sorted(out, key=str)


def expire(out, owner, rows, now):
    for r in rows.values():
        if r["open"] and r["expires"] <= now:
            r["open"] = False
            out.append((owner, r["id"], "expired", r["expires"]))


def test_question_lifecycle_against_a_plain_version(spark, tmp_path):
    rng, events, at = random.Random(9), [], T0
    for i in range(420):
        at += timedelta(minutes=rng.choice([1, 30, 200, 900]))
        owner = rng.choice(["u", "v", "w"])
        pair = f"{rng.randrange(40 if owner == 'w' else 6)}|x"
        events.append((at, i, owner, pair, rng.choice(["candidate"] * 5 + ["asked", "dismissed", "resolved"]) if owner != "w" else "candidate"))
    events.append((at + timedelta(days=60), 999, "z", "0|x", "candidate"))
    (tmp_path / "in").mkdir()
    path = files(spark, tmp_path / "in", [events[k : k + 106] for k in range(0, len(events), 106)], EVENTS)
    got = S.drained(Q.lifecycle(S.event_stream(spark, path, EVENTS)))
    want = plain_lifecycle(events, 3600_000, Q.MOST_OPEN)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {o for _, _, o, _ in want} == {"accepted", "active_pair", "recent", "cap", "asked", "dismissed", "resolved", "expired", "ignored"}


def test_what_is_still_open_counts(spark):
    """The streamed sessions and weeks hold all events, those of the last days too."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    for name in ("streamed_sessions", "streamed_weeks"):
        assert entry.queries()[name](spark, folder).agg(F.sum("n")).first()[0] == events


def test_a_call_reads_the_state_once(spark):
    """However many events an owner has in a trigger: their questions are read once and written once each."""

    class State(dict):
        reads = writes = 0

        def iterator(self):
            self.reads += 1
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, key, row):
            self.writes += 1
            self[key[0]] = row

        def containsKey(self, key):
            self.reads += 1
            return key[0] in self

        def getValue(self, key):
            self.reads += 1
            return self[key[0]]

    import pandas as pd

    class Handle:
        registerTimer = staticmethod(lambda at: None)

    q, state = Q.Questions(), State()
    q.handle, q.rows = Handle, state
    events = pd.DataFrame([(Q.DAY + k, k, f"{k % 5}|x", ["candidate", "asked", "resolved"][k % 3]) for k in range(3000)], columns=["at", "event_id", "pair", "kind"])
    out = pd.concat(list(q.handleInputRows(("u",), iter([events[:1000], events[1000:]]), None)))
    assert len(out) == 3000 and state.reads == 1 and state.writes == len(state) == 5
