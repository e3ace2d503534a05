"""Writes that touch several tables at once: validated, all or nothing, one writer at a time wins.

A store is a folder. Rows are written to folders of their own first, which nobody reads yet; then one file
``commits/<version>.json`` names, for every table, the folders that make it up. The file is created only if it
is not there, so of two writers that began at the same version one fails with ``Conflict``, and what a
failed or lost writer left is never seen. A reader takes the newest commit that is written out. A writer lost between
the creation of that file and its content leaves an empty file, which blocks its version until ``recovered``
removes it. (On object stores without create-if-absent, put ``commits`` on a file system that has it.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



class Conflict(Exception):
    """Another writer has committed since this one began."""


class Invalid(Exception):
    """Rows that fail a check."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def head(spark: SparkSession, store: str) -> int:
    """The newest version; 0 for an empty store."""
    p, fs = _path(spark, f"{store.rstrip('/')}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.getLen()] if fs.exists(p) else []
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)


def recovered(spark: SparkSession, store: str, age_ms: int = 600_000) -> int:
    """Remove the empty commit files of writers lost at least that long ago; how many."""
    import time

    p, fs = _path(spark, f"{store.rstrip('/')}/commits")
    lost = [f for f in fs.listStatus(p) if not f.getLen() and f.getModificationTime() <= time.time() * 1000 - age_ms] if fs.exists(p) else []
    return sum(bool(fs.delete(f.getPath(), False)) for f in lost)


def _manifest(spark: SparkSession, store: str, version: int) -> dict[str, dict]:
    if not version:
        return {}
    text = spark.read.text(f"{store.rstrip('/')}/commits/{version:012d}.json", wholetext=True).first()["value"]
    return json.loads(text)


def table(spark: SparkSession, store: str, name: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """A table as of a version (the newest if none); without any commit of it an empty one of ``schema``."""
    found = _manifest(spark, store, head(spark, store) if version is None else version).get(name)
    if found is None:
        if schema is None:
            raise KeyError(name)
        return spark.createDataFrame([], schema)
    return spark.read.schema(found["schema"]).parquet(*found["folders"])


def commit(spark: SparkSession, store: str, base: int, added: dict[str, DataFrame], checks: dict[str, Column] | None = None, replaced: tuple[str, ...] = ()) -> int:
    """Add rows to tables (or put them in the place of those named in ``replaced``), all in one version: ``base`` + 1.

    ``checks`` has a condition for each table's new rows, read back from what was written; rows for which it is false or
    null raise ``Invalid``, and nothing is committed. ``base`` is the version that the rows were made from.
    """
    store = store.rstrip("/")
    manifest = _manifest(spark, store, base)
    for name, rows in added.items():
        folder = f"{store}/rows/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        back = spark.read.schema(rows.schema).parquet(folder)
        ok = (checks or {}).get(name)
        if ok is not None and (bad := back.where(~F.coalesce(ok, F.lit(False))).count()):
            raise Invalid(f"{name}: {bad} rows fail their check")
        old = manifest.get(name)
        folders = [] if old is None or name in replaced else old["folders"]
        if folders and old["schema"] != _ddl(rows):
            raise Invalid(f"{name}: {_ddl(rows)} is not {old['schema']}")
        manifest[name] = {"schema": _ddl(rows), "folders": [*folders, folder]}
    p, fs = _path(spark, f"{store}/commits/{base + 1:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:  # py4j has no class for the file system's exception
        if fs.exists(p):
            raise Conflict(f"version {base + 1} is there already") from e
        raise
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return base + 1


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


#: Owners that cannot store, authorities that need the user's own words.
BLOCKED_OWNERS, USER_AUTHORITIES = ["system", "agent", "unknown"], ["user", "user_correction"]


def fact_problem() -> Column:
    """Why a fact may not be stored, null if it may: owner, content, class, authority without basis, class below its evidence."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank("owner"), "no owner")
        .when(F.col("owner").isin(BLOCKED_OWNERS), "blocked owner")
        .when(blank("content"), "no content")
        .when(~F.coalesce(F.col("classification").between(0, 2), F.lit(False)), "class")
        .when(F.col("classification") < F.coalesce("evidence_class", F.lit(0)), "class below its evidence")
        .when(F.col("authority").isin(USER_AUTHORITIES) & (~F.coalesce("user_evidence", F.lit(False)) | blank("basis")), "authority without basis")
    )


def fact_outcomes(incoming: DataFrame, stored: DataFrame, forgotten: DataFrame) -> DataFrame:
    """incoming with ``outcome``: a problem, ``forgotten``, ``known`` (the owner has that very content), ``repeated`` (earlier among the incoming) or ``stored``.

    incoming: request_id, owner, content, classification, authority, basis, evidence_class, user_evidence; stored: owner,
    content; forgotten: owner, content. Contents are compared trimmed. The exact content decides by two joins on equal
    content and one window over equal contents, so a known fact costs no write.
    """
    rows = incoming.withColumns({"content": F.trim("content"), "problem": fact_problem()})
    mark = lambda f, name: f.select("owner", F.trim("content").alias("content"), F.lit(True).alias(name)).distinct()
    rows = rows.join(mark(stored, "__known"), ["owner", "content"], "left").join(mark(forgotten, "__gone"), ["owner", "content"], "left")
    fits = F.col("problem").isNull() & F.col("__known").isNull() & F.col("__gone").isNull()
    w = Window.partitionBy("owner", "content", fits).orderBy("request_id")
    outcome = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("__gone"), "forgotten").when(F.col("__known"), "known").when(F.row_number().over(w) > 1, "repeated").otherwise("stored")
    return rows.withColumn("outcome", outcome).drop("problem", "__known", "__gone")


def store_facts(incoming: DataFrame, store: str, forgotten: DataFrame, tries: int = 5) -> DataFrame:
    """Store facts and their search documents in one version, again from the newest state after a conflict; the outcomes.

    The table ``facts`` has fact_id (the request's id), owner, content, classification, authority, revision; ``documents`` key,
    owner, version, safe_text, size.
    """
    from ..shared import written

    spark = incoming.sparkSession
    fields = "fact_id long, owner string, content string, classification int, authority string, revision int"
    for _ in range(tries):
        base = head(spark, store)
        outcomes = written(fact_outcomes(incoming, table(spark, store, "facts", base, fields), forgotten))
        new = outcomes.where("outcome = 'stored'").select(F.col("request_id").cast("long").alias("fact_id"), "owner", "content", F.col("classification").cast("int").alias("classification"), "authority", F.lit(1).alias("revision"))
        if not new.limit(1).count():
            return outcomes
        documents = new.select(F.concat_ws(":", F.lit("durable"), "owner", "fact_id").alias("key"), "owner", F.concat(F.lit("r"), "revision").alias("version"), F.col("content").alias("safe_text"), F.length("content").alias("size"))
        try:
            commit(spark, store, base, {"facts": new, "documents": documents}, {"facts": F.col("classification").between(0, 2) & (F.length("content") > 0), "documents": F.col("key").isNotNull()})
            return outcomes
        except Conflict:
            continue
    raise Conflict(f"{tries} tries")


def episode_outcomes(incoming: DataFrame, stored: DataFrame, messages: DataFrame) -> DataFrame:
    """(episode_id, outcome): ``known`` (the owner has one of the same messages), ``overlaps`` (shares a message with another one), ``unquoted`` or ``created``.

    incoming: episode_id, owner, ids (array of message ids), excerpts (array of struct<message_id, excerpt>); stored: owner, ids;
    messages: id, owner, content. An excerpt must stand in its message, which must be among the ids. Of new episodes that
    share messages the one with the smaller id is created.
    """
    digest = F.sha2(F.concat_ws(":", "owner", F.array_join(F.transform(F.array_sort("ids"), lambda i: i.cast("string")), ",")), 256)
    rows = incoming.withColumn("digest", digest)
    known = rows.join(stored.select(digest.alias("digest")).distinct(), "digest", "left_semi").select("episode_id", F.lit("known").alias("__known"))
    owned = rows.select("episode_id", "owner", F.explode("ids").alias("id"))
    old = stored.select("owner", F.explode("ids").alias("id")).distinct()
    quoted = rows.select("episode_id", "owner", "ids", F.explode("excerpts").alias("e")).join(messages.select(F.col("id").alias("__id"), F.col("owner").alias("__owner"), "content"), F.col("e.message_id") == F.col("__id"), "left")
    fine = F.array_contains("ids", F.col("e.message_id")) & (F.col("__owner") == F.col("owner")) & F.contains("content", F.col("e.excerpt")) & (F.length("e.excerpt") > 0)
    bad = quoted.where(~F.coalesce(fine, F.lit(False))).select("episode_id").distinct()
    good = owned.join(bad, "episode_id", "left_anti").join(known.select("episode_id"), "episode_id", "left_anti")
    shared = good.join(old, ["owner", "id"], "left_semi").select("episode_id").distinct()
    free = good.join(shared, "episode_id", "left_anti")
    first = free.groupBy("owner", "id").agg(F.min("episode_id").alias("first"))
    later = free.join(first, ["owner", "id"]).where("first < episode_id").select("episode_id").distinct()
    mark = lambda f, name: f.select("episode_id", F.lit(True).alias(name))
    out = rows.select("episode_id").join(known, "episode_id", "left").join(mark(bad, "__bad"), "episode_id", "left").join(mark(shared.unionByName(later).distinct(), "__over"), "episode_id", "left")
    outcome = F.when(F.col("__known").isNotNull(), "known").when(F.col("__bad"), "unquoted").when(F.col("__over"), "overlaps").otherwise("created")
    return out.select("episode_id", outcome.alias("outcome"))
