"""Line deduplication by winnowing over line hashes; DataFrame functions only.

A line is what stands between newlines, compared without the spaces around it; blank lines
are never counted or removed. A window is ``WINDOW`` consecutive lines that are not blank, or
one line of ``LONG`` characters or more. A line is removed when a window over it occurs
earlier: in a document with a smaller id, or earlier in the same one.

Winnowing picks, in every window, the line with the smallest hash (leftmost on ties) as a
fingerprint, so equal windows share a fingerprint and runs of lines need fewer rows than
windows. Fingerprints found once end there. The positions of shared ones are joined, matches
are extended both ways to the windows around each position, and of equal windows all but the
first have their lines deleted; adjacent windows add up to the repeated run.

Counts and first positions are partial aggregates, and joins are left to adaptive execution,
so a line that a third of all rows share is not gathered anywhere. Hashes have 64 bits.

Null texts stay null and empty ones empty. A document keeps its row when all its lines go.
Rows repeating both id and text are one document and all keep what it keeps; null ids come
last in order. ``n_chars``, where there is one, follows the text. Other columns pass through,
whatever their names (those starting with ``__line_`` are taken). Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LONG = 3, 200


def numbered(text: Column) -> Column:
    """array<struct<at, h, n>> of the lines that are not blank: index, hash, characters."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.trim(x)).alias("h"), F.char_length(F.trim(x)).alias("n"))), lambda x: x.n > 0)


def fingerprints(lines: Column, window: int = WINDOW, long: int = LONG) -> Column:
    """array<struct<fp, at, near>>: picked lines with the hashes and indexes around them; long lines have no ``near``."""

    def pick(i: Column) -> Column:
        inside = F.transform(F.slice(lines, i + 1, F.lit(window)), lambda x, k: F.struct(x.h.alias("h"), (i + k).alias("pos")))
        return F.array_min(inside).pos

    starts = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))

    def row(pos: Column) -> Column:
        first = F.greatest(pos - (window - 1), F.lit(0))
        near = F.transform(F.slice(lines, first + 1, pos - first + window), lambda x: F.struct(x.at.alias("at"), x.h.alias("h")))
        return F.struct(F.get(lines, pos).h.alias("fp"), F.get(lines, pos).at.alias("at"), near.alias("near"))

    none = F.array().cast("array<struct<at:int,h:bigint>>")
    alone = F.transform(F.filter(lines, lambda x: x.n >= long), lambda x: F.struct(x.h.alias("fp"), x.at.alias("at"), none.alias("near")))
    return F.concat(F.transform(F.array_distinct(F.transform(starts, pick)), row), alone)


def repeated_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """__line_doc, __line_text, at: indexes of the lines to remove; ``docs`` has these keys and ``text``."""
    rows = docs.select("__line_doc", "__line_text", F.explode(fingerprints(F.col("__lines"), window, long)).alias("f")).select("__line_doc", "__line_text", "f.*")
    rows = common.written(rows)
    # Rows repeating an id and a text have the same places: they don't make a line repeated.
    place = F.struct("__line_doc", "__line_text", "at")
    shared = rows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp")
    # Written and merged, so that both sides are plain exchanges, which adaptive execution can split, at every size.
    rows = rows.join(common.written(shared).hint("merge"), "fp")

    def around(i: Column) -> Column:
        inside = F.slice("near", i + 1, F.lit(window))
        return F.struct(F.xxhash64(F.transform(inside, lambda x: x.h)).alias("key"), F.transform(inside, lambda x: x.at).alias("ats"))

    several = F.transform(F.sequence(F.lit(0), F.size("near") - window), around)
    single = F.array(F.struct(F.xxhash64(F.array("fp")).alias("key"), F.array("at").alias("ats")))
    windows = rows.select("__line_doc", "__line_text", F.explode(F.when(F.size("near") == 0, single).otherwise(several)).alias("w")).select("__line_doc", "__line_text", "w.key", "w.ats")
    place = F.struct("__line_doc", "__line_text", F.get("ats", F.lit(0)).alias("at"))
    first = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "first")
    later = windows.join(common.written(first).hint("merge"), "key").where(place > F.col("first"))
    return later.select("__line_doc", "__line_text", F.explode("ats").alias("at"))


def deduplicated(docs: DataFrame, window: int = WINDOW, long: int = LONG, counts: bool = False) -> DataFrame:
    """``docs`` with the lines removed; with ``counts`` also n_lines and n_removed."""
    keyed = docs.withColumns({"__line_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__line_text": F.xxhash64("text")})
    parsed = keyed.select("__line_doc", "__line_text", numbered(F.col("text")).alias("__lines"))
    gone = repeated_lines(parsed, window, long).groupBy("__line_doc", "__line_text").agg(F.collect_set("at").alias("__line_gone"))
    both = keyed.join(gone.hint("merge"), ["__line_doc", "__line_text"], "left")

    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    text = F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = both.withColumn("__line_kept", text)
    kept = [F.col("__line_kept").alias("text") if c == "text" else F.char_length(F.coalesce("__line_kept", F.lit(""))).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        kept += [total.cast("long").alias("n_lines"), F.greatest(F.size(F.coalesce("__line_gone", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*kept)


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and the text that is left."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, i, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
  WHERE length(trim(l)) > 0),
win AS (
  SELECT doc_id, p, 3 AS n, trim(l) || chr(10) || lead(trim(l)) OVER w || chr(10) || lead(trim(l), 2) OVER w AS key
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL SELECT doc_id, p, 1, trim(l) FROM line WHERE length(trim(l)) >= {LONG}),
later AS (
  SELECT doc_id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS k FROM win WHERE key IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, (SELECT unnest([0, 1, 2]) AS d) WHERE d < n),
dead AS (SELECT doc_id, i FROM line JOIN gone USING (doc_id, p)),
left_over AS (
  SELECT doc_id, count(*) AS n_left, string_agg(l, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
  ANTI JOIN dead USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(n_left, 0) END AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""
