"""A published inverted index: a base and delta segments, merged on read.

A segment holds three tables. ``documents``: doc_id, version, size (tokens), letters, lang, gone.
``postings``: term, doc_id, tf, spots (positions), in folders by ``bucket`` of the term, so that asking
for terms reads their buckets only. ``vocabulary``: each term of the segment once, with its stem and
its plain form. A change writes one more segment: the new versions of documents that changed, and
tombstones (``gone``) of those that went. A document counts by its row in the newest segment that has
one; postings of older segments are left out on read, and ``compacted`` writes them out of the way.
Segments are listed in ``head``, one file a segment, written last: a segment without it is not seen,
so a job that fails half-way changes nothing. The head also has the number of buckets, which the base fixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stemmed
from ..shared import exists, tidy, written

BUCKETS = 16
#: Texts of an Arrow batch, and words that a Python worker sorts at once.
BATCH_ROWS, WORDS = 1000, 1 << 20
HEAD = "segment int, documents long, buckets int"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings_of(docs: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, spots) of docs (doc_id, text); the spots are counted in the document's order.

    A row's postings are made where its text is, so only texts are dealt out, and no word is shuffled. ``several``
    (doc_id) has the ids of more than one row; those rows' postings are put together.
    """
    words = docs.repartition("doc_id").select("doc_id", terms_of(F.col("text")).alias("words"))
    rows = words.mapInArrow(_listed, "term string, doc_id long, tf long, spots array<int>")
    if several is None:
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    ids = several.select(F.col("doc_id").alias("__id"))
    merged = rows.join(ids, same, "left_semi").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("spots"))).alias("spots"))
    return rows.join(ids, same, "left_anti").unionByName(merged)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (doc_id, words), at most about WORDS words at once: one stable sort by row and word."""
    for whole in batches:
        sizes = pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy()
        part = np.cumsum(sizes, dtype=np.int64) // WORDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            n, rows = sizes[at:end].astype(np.int64), end - at
            if not n.sum():
                continue
            words = whole.column(1).slice(at, rows).flatten().dictionary_encode()
            row, codes = np.repeat(np.arange(rows), n), words.indices.to_numpy()
            spot = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            key = row * len(words.dictionary) + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(first, len(key))
            lead = order[first]
            spots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(spot[order]))
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(codes[lead])), whole.column(0).slice(at, rows).take(pa.array(row[lead])), pa.array(np.diff(ends)), spots],
                names=["term", "doc_id", "tf", "spots"],
            )


def _head(path: str) -> str:
    return f"{path.rstrip('/')}/head"


def segments(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, _head(path)):
        return []
    return sorted(r.segment for r in spark.read.schema(HEAD).json(_head(path)).select("segment").distinct().collect())


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema(HEAD).json(_head(path)).agg(F.max("buckets").alias("n")).first()["n"]


def _write(docs: DataFrame, gone: DataFrame | None, path: str, segment: int, buckets: int) -> None:
    """One segment of docs (doc_id, version, text, lang) and tombstones (doc_id, version)."""
    spark = docs.sparkSession
    base = f"{path.rstrip('/')}/segment={segment}"
    made = docs.select("doc_id", F.col("version").cast("string").alias("version"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    rows = made.select("doc_id", "version", F.size(terms_of(F.col("text"))).alias("size"), F.length("text").alias("letters"), "lang", F.lit(False).alias("gone"))
    if gone is not None:
        nothing = F.lit(0)
        rows = rows.unionByName(gone.select("doc_id", F.col("version").cast("string").alias("version"), nothing.alias("size"), nothing.alias("letters"), F.lit(None).cast("string").alias("lang"), F.lit(True).alias("gone")))
    rows.write.mode("overwrite").parquet(f"{base}/documents")
    twice = spark.read.parquet(f"{base}/documents").where("NOT gone").groupBy("doc_id").count().where("count > 1").select("doc_id")
    found = postings_of(made, None if twice.isEmpty() else twice).withColumn("bucket", bucket_of(F.col("term"), buckets))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings")
    finally:
        spark.conf.set(key, before)
    words = spark.read.schema("term string, doc_id long, tf long, spots array<int>, bucket int").parquet(f"{base}/postings").select("term").distinct()
    words.select("term", stemmed(F.col("term")).alias("stem"), T.strip_diacritics(F.col("term")).alias("plain")).write.mode("overwrite").parquet(f"{base}/vocabulary")
    counted = spark.read.parquet(f"{base}/documents").agg(F.count("*").alias("documents")).select(F.lit(segment).alias("segment"), "documents", F.lit(buckets).alias("buckets"))
    counted.coalesce(1).write.mode("append").json(_head(path))
    tidy(spark)


def publish(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The base segment of docs (doc_id, version, text, lang)."""
    _write(docs, None, path, 0, buckets)


def states(spark: SparkSession, path: str) -> DataFrame:
    """Every document's newest row, with its segment; tombstones too."""
    rows = None
    for k in segments(spark, path):
        part = spark.read.parquet(f"{path.rstrip('/')}/segment={k}/documents").withColumn("segment", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    newest = F.max(F.struct("segment", "version", "size", "letters", "lang", "gone")).alias("v")
    return rows.groupBy("doc_id").agg(newest).select("doc_id", "v.*")


def live(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, segment, version, size, letters, lang of the documents that are there."""
    return states(spark, path).where("NOT gone").drop("gone")


def applied(docs: DataFrame, path: str) -> dict[str, int]:
    """Bring the index to docs (doc_id, version, text, lang): only new and changed versions are tokenised; what is no longer there goes.

    Returns the number of documents missing, stale and orphaned before. No segment is written when nothing differs.
    """
    spark = docs.sparkSession
    have = live(spark, path).select("doc_id", F.col("version").alias("__have"))
    want = docs.select("doc_id", F.col("version").cast("string").alias("__want"))
    both = want.join(have, "doc_id", "full")
    state = F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "orphaned").when(F.col("__have") != F.col("__want"), "stale")
    found = written(both.withColumn("state", state).where("state IS NOT NULL"))
    counts = {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
    if counts:
        changed = docs.join(found.where("state <> 'orphaned'").select("doc_id"), "doc_id", "left_semi")
        gone = found.where("state = 'orphaned'").select("doc_id", F.col("__have").alias("version"))
        _write(changed, gone, path, segments(spark, path)[-1] + 1, _buckets(spark, path))
    return counts


def postings(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, spots) of the live documents, of the asked terms (term) if given.

    The newest segment's postings all count; of an older one those of documents that no newer segment has.
    """
    listed, out, buckets = segments(spark, path), None, _buckets(spark, path)
    schema = "term string, doc_id long, tf long, spots array<int>, bucket int"
    for k in listed:
        part = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/segment={k}/postings")
        if asked is not None:  # the bucket prunes folders, the term the rows
            part = part.join(asked.select("term", bucket_of(F.col("term"), buckets).alias("bucket")).distinct(), ["bucket", "term"], "left_semi")
        part = part.drop("bucket")
        newer = [f"{path.rstrip('/')}/segment={n}/documents" for n in listed if n > k]
        if newer:
            part = part.join(spark.read.parquet(*newer).select("doc_id"), "doc_id", "left_anti")
        part = part.select("term", "doc_id", "tf", "spots")
        out = part if out is None else out.unionByName(part)
    return out


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, stem, plain), each term once; terms of documents that went may still be listed."""
    listed, out = segments(spark, path), None
    for k in listed:
        part = spark.read.parquet(f"{path.rstrip('/')}/segment={k}/vocabulary")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["term"]) if len(listed) > 1 else out


def compacted(spark: SparkSession, path: str, to: str, buckets: int = BUCKETS) -> None:
    """The live documents' rows as one base segment at another path; nothing is tokenised."""
    base = f"{to.rstrip('/')}/segment=0"
    live(spark, path).drop("segment").withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{base}/documents")
    rows = postings(spark, path).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings")
    kept = spark.read.parquet(f"{base}/postings").select("term").distinct()
    vocabulary(spark, path).join(kept, "term", "left_semi").write.mode("overwrite").parquet(f"{base}/vocabulary")
    spark.range(1).select(F.lit(0).alias("segment"), F.lit(live(spark, path).count()).alias("documents"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("append").json(_head(to))


def backfilled(docs: DataFrame, vectors: DataFrame, model: str, dim: int, provider, batch: int = 64) -> DataFrame:
    """Vectors (doc_id, version, model, dim, vector) of docs (doc_id, version, text): those of this model, dimension and version
    stay, the others are made; a provider's answer of another dimension is left out, and tried again next time."""
    from ..functions.embedding import embedded

    version = F.col("version").cast("string").alias("version")
    right = vectors.where((F.col("model") == model) & (F.col("dim") == dim) & (F.size("vector") == dim))
    kept = right.join(docs.select("doc_id", version), ["doc_id", "version"], "left_semi").select("doc_id", "version", "model", "dim", "vector")
    todo = docs.select("doc_id", version, "text").join(kept.select("doc_id"), "doc_id", "left_anti")
    made = todo.select("doc_id", "version", F.lit(model).alias("model"), F.lit(dim).alias("dim"), embedded(F.coalesce("text", F.lit("")), provider, batch).alias("vector"))
    return kept.unionByName(made.where(F.size("vector") == dim))


def swapped(made: DataFrame, current: DataFrame) -> DataFrame:
    """Of vectors made from a snapshot, those whose document still has that version (compare and swap)."""
    return made.join(current.select("doc_id", F.col("version").cast("string").alias("version")), ["doc_id", "version"], "left_semi")
