"""Heads of summary files: what is opened, what is believed; what is due."""

from datetime import date

import pytest

from tesserae.operators import cadence as K
from tesserae.sources import artifacts as A

WEEK = "Owner: {o}\nPeriod-Start: {a}\nPeriod-End: {b}\nSources: {s}\nCovered: all\n\nbody"


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text if isinstance(text, bytes) else text.encode())


def week(o="u1", a="2024-01-01", b="2024-01-07", s="d1, d2"):
    return WEEK.format(o=o, a=a, b=b, s=s)


@pytest.fixture()
def root(tmp_path):
    for a, b in [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-28")]:
        put(tmp_path, f"u1/weekly_{a}_{b}.md", week(a=a, b=b))
    return tmp_path


def names(root, tier="weekly", ranges=(), newest=0, **part):
    return [r["path"].rpartition("_2024-")[0][-10:] for r in A.listed(str(root), tier, list(ranges), newest, **part)]


def test_pruned_files_are_not_opened(spark, root):
    put(root, "u1/weekly_2024-13-01_2024-13-07.md", "never read")
    assert names(root, ranges=[("2024-01-14", "2024-01-15")]) == ["2024-01-15", "2024-01-08"]
    assert names(root, newest=1) == ["2024-01-15"]
    rows = {r.path[10:20]: r for r in A.heads(spark, str(root), "weekly").collect()}
    assert len(rows) == 4 and rows["2024-13-01"].head is None and rows["2024-01-01"].head
    assert [r.more for r in A.heads(spark, str(root), "weekly", newest=1).collect()] == [True]


def test_slices_list_each_file_once(root):
    for n in range(20):
        put(root, f"o{n}/weekly_2024-01-01_2024-01-07.md", week())
    put(root, "weekly_2024-01-01_2024-01-07.md", week())
    parts = [[r["path"] for r in A.listed(str(root), "weekly", [], 0, i, 4)] for i in range(4)]
    assert sorted(sum(parts, [])) == sorted(str(p.relative_to(root)) for p in root.rglob("*.md"))
    assert sum(map(bool, parts)) > 1


def test_only_the_head_is_read(root):
    put(root, "daily_2024-01-02-0300Z.md", b"# Daily Summary 2024-01-01\n" + b"x" * 5000 + b"\nOwner: u2")
    system, base = A._open(f"file:{root}")
    assert len(A.head(system, f"{base}/daily_2024-01-02-0300Z.md", "daily")) == A.HEAD_BYTES["daily"]
    assert A.head(system, f"{base}/gone.md", "daily") is None


def test_weekly_heads_are_believed_when_whole(spark, tmp_path):
    name = "{}/weekly_2024-01-01_2024-01-07.md"
    bad = {"short": "Owner: u1\nPeriod-Start: 2024-01-01\nPeriod-End: 2024-01-07\nSources: d1", "other": week(b="2024-01-14"), "nobody": week(o=" "), "no_sources": week().replace("Sources", "Files"), "empty": "", "bytes": b"\xff\xfe"}
    for k, text in bad.items():
        put(tmp_path, name.format(k), text)
    put(tmp_path, name.format("good"), week(s=" d1 ,,d2 ").replace("\n", "\r\n"))
    put(tmp_path, "days/weekly_2024-01-02_2024-01-08.md", week(a="2024-01-02", b="2024-01-08"))
    put(tmp_path, "quarter/quarterly_2024-Q4.md", week(a="2024-10-01", b="2024-12-31", s=""))
    found = A.tier_artifacts(A.heads(spark, str(tmp_path), "weekly"), "weekly").collect()
    assert len(found) == len(bad) + 2
    assert [(r.folder, r.owner, r.sources) for r in found if r.valid] == [("good", "u1", ["d1", "d2"])]
    (q,) = A.tier_artifacts(A.heads(spark, str(tmp_path), "quarterly"), "quarterly").collect()
    assert (q.start_day, q.end_day, q.sources, q.valid) == (date(2024, 10, 1), date(2024, 12, 31), [], True)


def test_daily_windows(spark, tmp_path):
    put(tmp_path, "daily_2024-01-05-0310Z.md", "# Daily Summary 2024-01-03 — 2024-01-04\nOwner: u1\n")
    put(tmp_path, "daily_2024-01-06.md", "Owner: u2\ntext")
    put(tmp_path, "daily_2024-01-07.md", "# Daily Summary 2024-01-01\ntext\nOwner: u3")
    put(tmp_path, "daily_2024-01-08-0000Z.md", "# Daily Summary 2024-02-30\nOwner: u4")
    put(tmp_path, "daily_2024-01-09-0000Z.md", "# Daily Summary 2024-01-05 — 2024-01-04\nOwner: u4")
    put(tmp_path, "daily_2024-02-31.md", "Owner: u5")
    rows = {r.path[6:]: tuple(r)[1:] for r in A.daily_covers(A.heads(spark, str(tmp_path), "daily")).collect()}
    assert rows == {
        "2024-01-05-0310Z.md": ("u1", date(2024, 1, 3), date(2024, 1, 4), 1704424200000),
        "2024-01-06.md": ("u2", date(2024, 1, 6), date(2024, 1, 6), 1704499200000),
        "2024-01-07.md": (None, date(2024, 1, 1), date(2024, 1, 1), -1),
    }


def test_nothing_there(spark, tmp_path):
    assert A.heads(spark, str(tmp_path / "none"), "daily").count() == 0
    assert A.tier_artifacts(A.heads(spark, str(tmp_path), "weekly"), "weekly").count() == 0


def test_published_again(spark, tmp_path):
    rows = spark.createDataFrame([("a/weekly_2024-01-01_2024-01-07.md", week()), ("b/c.md", "")], "path string, text string")
    A.publish(rows, str(tmp_path))
    A.publish(rows, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/weekly_2024-01-01_2024-01-07.md", "b/c.md"]
    assert (tmp_path / "a/weekly_2024-01-01_2024-01-07.md").read_text() == week()


def test_weekly_gap_is_cut_at_eight_weeks(spark):
    days = "owner string, path string, start_day date, end_day date, valid boolean"
    done = [("gap", "p", date(2024, 1, 1), date(2024, 1, 7), True), ("now", "p", date(2024, 4, 1), date(2024, 4, 7), True), ("next", "p", date(2024, 3, 25), date(2024, 3, 31), True), ("cut", "p", date(2024, 4, 1), date(2024, 4, 7), False)]
    owners = spark.createDataFrame([(o, date(2024, 4, 14)) for o in ("gap", "now", "next", "cut")], "owner string, run_day date")
    got = {r.owner: (r.due, str(r.start_day), str(r.end_day), r.cutover, r.capped) for r in K.weekly_due(owners, spark.createDataFrame(done, days)).collect()}
    assert got == {
        "gap": (True, "2024-01-08", "2024-03-03", False, True),
        "now": (False, "2024-04-01", "2024-04-07", False, False),
        "next": (True, "2024-04-01", "2024-04-07", False, False),
        "cut": (True, "2024-04-01", "2024-04-07", True, False),
    }


def test_endless_cover_is_cut_before_it_is_spread(spark):
    covers = spark.createDataFrame([("u1", "all", date(1, 1, 1), date(9999, 1, 1), 1), ("u1", "b", date(2024, 1, 2), date(2024, 1, 2), 1), (None, "c", date(2024, 1, 1), date(2024, 1, 3), 9)], "owner string, path string, start_day date, end_day date, stamp long")
    due = spark.createDataFrame([("u1", date(2024, 1, 1), date(2024, 1, 3)), ("u2", date(2024, 1, 1), date(2024, 1, 1))], "owner string, start_day date, end_day date")
    got = {(r.owner, r.day.day): r.path for r in K.daily_inputs(covers, due).collect()}
    assert got == {("u1", 1): "all", ("u1", 2): "b", ("u1", 3): "all", ("u2", 1): None}


def test_folders_that_may_hide_the_latest(spark, tmp_path):
    put(tmp_path, "a/weekly_2024-01-01_2024-01-07.md", week())
    put(tmp_path, "a/weekly_2024-01-08_2024-01-14.md", "broken")
    put(tmp_path, "b/weekly_2024-01-08_2024-01-14.md", "broken")
    scan = lambda n: [r.folder for r in K.incomplete_folders(A.tier_artifacts(A.heads(spark, str(tmp_path), "weekly", newest=n), "weekly")).collect()]
    assert (scan(1), scan(2)) == (["a"], [])
