"""Quality classifier by importance resampling over hashed n-gram models.

Two generative models over hashed n-grams (words, punctuation runs, word beginnings, levels
of immediate repetition; each once a document) are compared: the target (documents labelled
good: quality 1 and toxic 0) and the raw text (every document). A document's log importance
weight is the sum, over its n-grams, of log p_target - log p_raw, shrunk towards 0, where that
differs by more than chance. Documents are drawn without replacement by Gumbel top-k: the k largest
(log weight / TEMPERATURE + Gumbel noise) are accepted: a sample whose members are drawn one
by one with odds of weight ** (1 / TEMPERATURE), where k is the number of documents
whose weight clears the threshold that separates the labelled documents best.

What is fitted on a bounded sample: the target model and the threshold, on at most
``LABELLED`` labelled rows (lowest hash of the id first, whatever the table's size). One of
``FOLDS`` of them sets the threshold and takes no part in the models, since documents fit a
model that has seen them too well. The raw model, the weights, k and the draw cover all documents. The models are ``BUCKETS`` counters
each, a fixed size, so their broadcast does not grow with the corpus.

Null and empty texts have no n-grams and weight 0. A document is drawn on its own id and
text, so repeated rows share weight and noise and stay or go together as far as k cuts
between keys; ties at the cut stay together. Without usable labels, or with an empty table,
every document is accepted with weight 0. Null labels are no labels; labels of one document
that contradict each other count as the worst of them. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 20
#: Bound of the labelled sample, and its parts, one of which sets the threshold.
LABELLED, FOLDS = 20_000, 4
#: Raw documents below which a bucket says nothing; prior count; standard errors that count as more than chance.
MIN_COUNT, PRIOR, CHANCE = 8, 0.5, 3.0
#: Nats of a log ratio that count for nothing: what near copies and small samples make. Others kept that weigh as much as a good one lost.
SHRINK, LOSS = 1.0, 3.0
#: Odds are the squares of the importance weights.
TEMPERATURE = 0.5

#: Bytes of the word beginnings that count as n-grams; levels (2, 4, 8, ...) of words that repeat the word before.
PREFIXES, REPEATS = (4, 5, 6), 12

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letters, 2 digits, 3 other
_KIND[0x21:0x80] = 3
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_a:_b] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x7F] = 0
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_LOWER = (_LOWER + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_UPPER = np.zeros(256, np.int32)
_UPPER[0x41:0x5B] = 1
_BASE, _MIX = 0xD6E8FEB86659FD93, np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Features:
    """Bucket and document number of the distinct n-grams of each text in a block."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        starts = edge[:-1]
        word = kind[starts] > 0
        starts, ends = starts[word], edge[1:][word]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        caps = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_UPPER[data], out=caps[1:])
        h += np.uint64(0x5851F42D4C957F2D) * ((caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1))
        h = (h ^ (h >> np.uint64(29))) * _MIX
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        found, of = [h], [doc]
        for k, size in enumerate(PREFIXES):
            long = ends - starts > size
            at = starts[long]
            prefix = (sums[at + size] - sums[at]) * self.down[at] + np.uint64(k + 1)
            found.append((prefix ^ (prefix >> np.uint64(29))) * _MIX)
            of.append(doc[long])
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
        for level in range(REPEATS):
            of.append(np.flatnonzero(again >= 2 << level))
            found.append(np.full(len(of[-1]), np.uint64((level + 1) * int(_MIX) & (1 << 64) - 1)))
        keys = np.unique(np.concatenate(of) << 20 | (np.concatenate(found) >> np.uint64(44)).astype(np.int64))
        return keys & (BUCKETS - 1), keys >> 20


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, good, fold) of at most ``bound`` labelled documents, lowest hash of the id first."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0))
    usable = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return usable.groupBy("doc_id").agg(good.alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))


class Models:
    """Documents with each bucket: in the raw text, in the target, among labelled documents that are not good."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, other: np.ndarray):
        self.raw, self.target, self.other = raw, target, other

    def log_ratio(self) -> np.ndarray:
        """log p_target - log p_raw by bucket; 0 where it may be chance."""
        n_raw, n_target, n_other = self.raw.sum(), self.target.sum(), self.other.sum()
        if not n_raw or not n_target:
            return np.zeros(len(self.raw), np.float32)
        share, fair = n_target / n_raw, n_target / (n_target + n_other)
        expected, labelled = self.raw * share, self.target + self.other
        far = np.abs(self.target - expected) / np.sqrt(expected * (1 - share) + 1e-9)
        apart = np.abs(self.target - labelled * fair) / np.sqrt(labelled * fair * (1 - fair) + 1e-9)
        out = np.log((self.target + PRIOR) / (expected + PRIOR))
        out[(np.maximum(far, apart) < CHANCE) | (self.raw < MIN_COUNT)] = 0
        return (np.sign(out) * np.maximum(np.abs(out) - SHRINK, 0)).astype(np.float32)


def counted(docs: DataFrame, sample: dict[int, int]) -> Models:
    """The models over all documents; ``sample``: good or not by id, at most LABELLED."""
    ids = np.array(sorted(sample), np.int64)
    good = np.array([sample[i] for i in ids.tolist()], bool)
    chosen = docs.sparkSession.sparkContext.broadcast((ids, good))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts, (ids, good) = Features(), np.zeros((3, BUCKETS), np.int32), chosen.value
        for block in common.blocks(batches, "text", 1 << 20):
            bucket, doc = features(common.utf8(block.column(1)))
            counts[0] += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
            if len(ids):
                own = block.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                known = ids[at] == own
                for k, mine in ((1, known & good[at]), (2, known & ~good[at])):
                    if mine.any():
                        counts[k] += np.bincount(bucket[mine[doc]], minlength=BUCKETS).astype(np.int32)
        seen = np.flatnonzero(counts[0])
        for a in range(0, len(seen), 50_000):
            b = seen[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(b), *(pa.array(c[b].astype(np.int64)) for c in counts)], names=["bucket", "raw", "target", "other"])

    parts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sums = parts.mapInArrow(work, "bucket long, raw long, target long, other long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "target", "other")))
    got = sums.toArrow()  # at most BUCKETS rows
    out = np.zeros((3, BUCKETS), np.int64)
    for k, c in enumerate(("raw", "target", "other")):
        out[k, got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    return Models(*out)


def weight_column(spark: SparkSession, ratio: np.ndarray, text: str = "text"):
    """Log importance weight of a text, as a column: rows stay where they are."""
    shared = spark.sparkContext.broadcast(ratio)
    kept: list[Features] = []

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        kept or kept.append(Features())
        out = []
        for block in common.blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 1 << 20):
            raw = common.utf8(block.column(0))
            bucket, doc = kept[0](raw)
            out.append(np.bincount(doc, weights=shared.value[bucket], minlength=len(raw)))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return weight(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def draw_key(weight, doc_id: str = "doc_id"):
    """weight / TEMPERATURE + Gumbel noise that is a function of the id."""
    u = (F.pmod(F.xxhash64(F.lit("gumbel"), F.col(f"`{doc_id}`")), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    return weight / TEMPERATURE - F.log(-F.log(u))


def separating(weights: np.ndarray, good: np.ndarray) -> float:
    """The threshold at which LOSS * (share of good kept) - (share of others kept) is largest; midway to the next weight below."""
    if not len(weights) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(-weights, kind="stable")
    w, g = weights[order], good[order]
    gain = LOSS * np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    last = np.r_[w[1:] != w[:-1], True]
    at = int(np.argmax(np.where(last, gain, -np.inf)))
    return float((w[at] + w[at + 1]) / 2) if at + 1 < len(w) else -np.inf


def kth_largest(keys: DataFrame, column: str, k: int, small: int = 10_000) -> float:
    """Exact k-th largest value by histograms: each pass narrows to the bin with rank k; no sort, no large collect."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = keys.where((F.col(column) >= lo) & (F.col(column) <= hi))
        step = (hi - lo) / 1000
        if step <= abs(hi) * 1e-15 or lo == hi:
            return lo
        bins = F.least(F.floor((F.col(column) - lo) / step), F.lit(999))
        found = inside.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()  # 1000 rows
        for b in found:
            if above + b.n >= k:
                lo, hi, n = b.lo, b.hi, b.n
                break
            above += b.n
        if n <= small:
            return sorted((r[0] for r in keys.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()), reverse=True)[k - above - 1]


def fitted(docs: DataFrame, labels: DataFrame):
    """(log ratios, key that a document must reach, scored table or None). The scored table has doc_id, log_weight and key of every row."""
    spark = docs.sparkSession
    rows = labelled_sample(labels).collect()
    seen, held = ({r.doc_id: r.good for r in rows if (r.fold == 0) == out} for out in (False, True))
    if len(set(held.values())) < 2 or not any(seen.values()):  # too few labels to hold any out
        seen = held = seen | held
    ratio = counted(docs, seen).log_ratio()
    if not ratio.any():
        return ratio, None, None
    scored = common.written(docs.select("doc_id", weight_column(spark, ratio).alias("log_weight")).withColumn("key", draw_key(F.col("log_weight"))))
    ids = spark.createDataFrame(list(held.items()), "doc_id long, good int")
    labelled = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("log_weight"), F.min("good")).collect()  # at most LABELLED
    at = separating(np.array([r[1] for r in labelled]), np.array([r[2] for r in labelled], bool))
    k = scored.where(F.col("log_weight") >= at).count()
    return ratio, (kth_largest(scored, "key", k) if k else float("inf")), scored


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns."""
    ratio, cut, scored = fitted(docs, labels)
    if cut is None:
        return docs
    common.dropped(scored)
    return docs.where(draw_key(weight_column(docs.sparkSession, ratio)) >= cut)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """The drawn documents: doc_id, log_weight, key."""
    docs = common.table(spark, sf_dir, "documents")
    _, cut, scored = fitted(docs, common.table(spark, sf_dir, "labels"))
    if cut is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), draw_key(F.lit(0.0)).alias("key"))
    return scored.where(F.col("key") >= cut)
