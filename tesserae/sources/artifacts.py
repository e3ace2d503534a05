"""Summary files of three tiers: tasks list names, prune by the period in them and read heads only; a sink of one file a row."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import shipped

#: Forms of file names, and bytes of a file that may be read for its head.
NAMES = {"daily": r"daily_(\d{4})-(\d{2})-(\d{2})(?:-(\d{2})(\d{2})Z)?\.md", "weekly": r"weekly_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.md", "quarterly": r"quarterly_(\d{4})-Q([1-4])\.md"}
HEAD_BYTES = {"daily": 4096, "weekly": 65536, "quarterly": 65536}
HEAD_LINES = 5
NAMES_SCHEMA = "path string, folder string, start_day date, end_day date, written long, known boolean, nth int, more boolean"
#: Rows of a batch.
ROWS = 500


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it; Hadoop's file:/x means /x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root.rstrip("/")))


def _day(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def named(tier: str, name: str) -> tuple[date | None, date | None, int | None] | None:
    """(first day, last day, time written in ms) as a file's name states them; None for a name of another form."""
    if not (m := re.fullmatch(NAMES[tier], name)):
        return None
    if tier == "weekly":
        first, last = _day(m[1]), _day(m[2])
        return (first, last, None) if first and last and first <= last else None
    if tier == "quarterly":
        year, quarter = int(m[1]), int(m[2])
        if not 1 <= year < 9999:
            return None
        after = date(year + quarter // 4, quarter % 4 * 3 + 1, 1)
        return date(year, quarter * 3 - 2, 1), after - timedelta(days=1), None
    if m[4] is None:
        day = _day(name[6:16])
        return (day, day, None) if day else None
    year, month, nth, hour, minute = (int(g) for g in m.groups())
    if not (year and 1 <= month <= 12 and 1 <= nth <= 31 and hour <= 23 and minute <= 59):
        return None, None, None
    at = datetime(year, month, 1, hour, minute, tzinfo=timezone.utc) + timedelta(days=nth - 1)
    return None, None, int(at.timestamp()) * 1000


def slice_of(entry: str, of: int) -> int:
    return zlib.crc32(entry.encode()) % of


def listed(root: str, tier: str, ranges: list[tuple[str, str]], newest: int, part: int = 0, of: int = 1) -> Iterator[dict]:
    """One slice of a tier's files, by name alone: with ranges those whose period meets one, with ``newest`` the last ones of each folder.

    A slice lists the entries of the root and goes down into its own ones only; files at the root itself are the first slice's.
    """
    system, base = _open(root)
    spans = [(date.fromisoformat(a), date.fromisoformat(b)) for a, b in ranges]
    folders: dict[str, list[tuple]] = {}
    for entry in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if entry.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(entry.path, allow_not_found=True, recursive=True)) if slice_of(entry.base_name, of) == part else []
        else:
            found = [entry] if part == 0 else []
        for info in found:
            name = info.base_name
            if info.type != fs.FileType.File or not name.endswith(".md") or not name.startswith(f"{tier}_"):
                continue
            period = named(tier, name)
            first, last, written = period or (None, None, None)
            if spans and not (first and any(last >= a and first <= b for a, b in spans)):
                continue
            path = info.path[len(base):].lstrip("/")
            folders.setdefault(path.rpartition("/")[0], []).append((path, first, last, written, period is not None))
    for folder, rows in folders.items():
        rows.sort(key=lambda r: (r[2] or date.min, r[0]), reverse=True)
        kept = rows[:newest] if newest else rows
        for nth, (path, first, last, written, known) in enumerate(kept, 1):
            yield {"path": path, "folder": folder, "start_day": first, "end_day": last, "written": written, "known": known, "nth": nth, "more": len(rows) > len(kept)}


def head(system: fs.FileSystem, path: str, tier: str) -> str | None:
    """The first lines; None for a file that is gone or closed to us. Other errors fail the task, which Spark repeats."""
    try:
        with system.open_input_file(path) as f:
            data = f.read_at(min(f.size(), HEAD_BYTES[tier]), 0)
    except (FileNotFoundError, PermissionError):
        return None
    return "\n".join(data.decode("utf-8", "replace").split("\n")[:HEAD_LINES])


def heads(spark: SparkSession, root: str, tier: str, ranges: list[tuple[str, str]] | None = None, newest: int | None = None, slices: int = 32) -> DataFrame:
    """Heads of a tier's files: path (below the root), folder, period and time of the name, head, nth (newest of its folder first), more (its folder has files that were not opened).

    Nothing is known of a file but its name before it is opened. An empty or missing root has no rows. Tasks list the
    folders, the driver none; names are dealt anew before heads are read, so that one large folder is no single task.
    Each use reads the heads again: write them where they are used more than once.
    """
    shipped(spark)
    asked, most = list(ranges or []), newest or 0
    fields = [("path", pa.string()), ("folder", pa.string()), ("start_day", pa.date32()), ("end_day", pa.date32()), ("written", pa.int64()), ("known", pa.bool_()), ("nth", pa.int32()), ("more", pa.bool_())]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = listed(root, tier, asked, most, part, slices)
                while some := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema=pa.schema(fields))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = batch.slice(at, ROWS)
                known = block.column(5).to_pylist()
                read = [head(system, f"{base}/{path}", tier) if k else None for path, k in zip(block.column(0).to_pylist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(read, pa.string())], names=[*block.schema.names, "head"])

    files = spark.range(0, slices, 1, slices).mapInArrow(names, NAMES_SCHEMA)
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(opened, f"{NAMES_SCHEMA}, head string").drop("known")


def _line(n: int):
    return F.regexp_replace(F.get(F.split("head", "\n"), F.lit(n)), r"^\s+|\s+$", "")


def _owner(n: int):
    return F.nullif(F.trim(F.regexp_extract(_line(n), r"^Owner: (.+)$", 1)), F.lit(""))


def daily_covers(found: DataFrame) -> DataFrame:
    """(path, owner, start_day, end_day, stamp): the heading's window, else the day of a name without a time; files with neither are left out.

    The owner is null where no head line states it. The stamp is the name's time, -1 where a heading goes with a name without one.
    """
    heading = r"^# Daily Summary (\d{4}-\d{2}-\d{2})(?: — (\d{4}-\d{2}-\d{2}))?$"
    first = F.try_to_date(F.regexp_extract(_line(0), heading, 1))
    last = F.coalesce(F.nullif(F.regexp_extract(_line(0), heading, 2), F.lit("")), F.regexp_extract(_line(0), heading, 1))
    last = F.try_to_date(last)
    good = F.coalesce(first <= last, F.lit(False))
    owner = F.coalesce(_owner(0), F.when(_line(0).startswith("# Daily Summary"), _owner(1)))
    rows = found.where("head IS NOT NULL").select(
        "path",
        owner.alias("owner"),
        F.when(good, first).otherwise(F.col("start_day")).alias("start_day"),
        F.when(good, last).otherwise(F.col("end_day")).alias("end_day"),
        F.when(good, F.coalesce("written", F.lit(-1))).otherwise(F.unix_date("start_day").cast("bigint") * 86_400_000).alias("stamp"),
    )
    return rows.where("start_day IS NOT NULL")


def tier_artifacts(found: DataFrame, tier: str) -> DataFrame:
    """(path, folder, owner, start_day, end_day, sources, valid, nth, more) of weekly or quarterly files.

    Valid is a file of five head lines that states an owner, a list of sources and the very period of its name; a weekly
    period runs from a Monday to a Sunday. Of others path, folder, nth and more are known only.
    """
    day = lambda n, key: F.try_to_date(F.nullif(F.regexp_extract(_line(n), rf"^Period-{key}: (\d{{4}}-\d{{2}}-\d{{2}})$", 1), F.lit("")))
    whole = (F.size(F.split("head", "\n")) >= HEAD_LINES) & F.get(F.split("head", "\n"), F.lit(3)).startswith("Sources:")
    period = (day(1, "Start") == F.col("start_day")) & (day(2, "End") == F.col("end_day"))
    if tier == "weekly":
        period &= (F.weekday("start_day") == 0) & (F.weekday("end_day") == 6)
    valid = F.coalesce(whole & period & _owner(0).isNotNull(), F.lit(False))
    listed = F.transform(F.split(F.substr(_line(3), F.lit(len("Sources:") + 1)), ","), lambda x: F.trim(x))
    kept = lambda c: F.when(F.col("valid"), c)
    rows = found.withColumn("valid", valid)
    return rows.select("path", "folder", kept(_owner(0)).alias("owner"), kept(F.col("start_day")).alias("start_day"), kept(F.col("end_day")).alias("end_day"), kept(F.filter(listed, lambda x: x != "")).alias("sources"), "valid", "nth", "more")


def publish(files: DataFrame, root: str) -> None:
    """One file for each row (path below the root, text), each under another name until it is whole; a repeated task writes the same again."""

    def write(batches):
        system, base = _open(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.part-{id(batch):x}"
                with system.open_output_stream(part) as out:
                    out.write(text.encode())
                system.move(part, target)
            yield batch[["path"]]

    shipped(files.sparkSession)
    files.select("path", "text").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
