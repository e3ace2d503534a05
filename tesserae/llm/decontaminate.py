"""Benchmark decontamination: rare n-gram seeds join texts to items, Smith-Waterman alignment scores the pairs.

Words are runs of digits and letters, lower-cased. The Smith-Waterman score of item and text
over the score of a verbatim copy is the similarity; from ``MIN_SIMILARITY`` on the document
contains the item. Items of fewer than 2 * ``N`` words ask for the score of ``N`` words in a
row at least (of the whole item, where it is shorter), as half of them says nothing.

1. Seeds are n-grams of one word or of ``N`` words. One pass over the texts counts in how many each of the
   benchmark's n-grams occurs. Each item then takes the rarest seeds that no alignment of its score can miss:
   such a score takes s / ``MATCH`` words of the item, so of its rarest words, ``EXTRA`` and one more than may be
   missing, the text has ``EXTRA`` + 1 at least (``words``); or it shares an ``N``-gram, or else its matches stand in runs of fewer
   than ``N`` words, with a loss between any two runs, which takes more words, so that fewer of the rarest ones do
   (``grams``). An item takes the set that occurs in fewer texts. No n-gram is left out for being frequent.
2. A second pass gives the texts' n-grams among those seeds; they meet the items on equal seeds, and a pair with
   an ``N``-gram or with enough words is a candidate.
3. Candidate items go to their texts, in groups of at most about ``GROUP``, and are aligned there. A bound goes first:
   a stretch of text scores at most ``MATCH`` for a word of the item and ``MISMATCH`` or ``GAP`` for another;
   stretches on which such a running sum stays above 0 are aligned where its peak reaches the score.

Both passes know the n-grams by a bitmap of ``BITS`` bits, whatever the benchmark's size, and only texts whose hash is in
such a bitmap of candidate texts are shuffled. Bitmaps let too much through, never too little. Texts are named by
128 bits of hash, so repeated ones are aligned with the same items.

Null and empty texts and items match nothing. Repeated rows repeat their result; of several
alignments of one item in a document the best counts, the earliest on ties. Empty tables give
no leaks and leave documents as they are. Null ids pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

N, MIN_SIMILARITY = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmaps that go to the workers.
BITS = 1 << 24
#: Rarest words besides those that a text must have one of; it must have as many more.
EXTRA = 3
#: Items that are aligned with a text at once.
GROUP = 500

_LETTER = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _MIX = 0x9D39247E33776D41, np.uint64(0xFF51AFD7ED558CCD)

_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(0x20 if b in _DELIMITERS else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split() if text else []


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end) of the best local alignment, in positions of ``text``."""
    n = len(text)
    column = np.arange(n + 1)
    above, start_above = np.zeros(n + 1, np.int64), column.copy()
    best = (0, 0, 0)
    for w in item:
        row = np.zeros(n + 1, np.int64)
        start = column.copy()
        diagonal = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = above[1:] + GAP
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(row[1:] == 0, column[1:], np.where(diagonal >= up, start_above[:-1], start_above[1:]))
        # A gap along the row: the largest row[k] + GAP * (j - k), as a running maximum.
        lifted = row - GAP * column
        top = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == top, column, 0))
        row, start = top + GAP * column, start[origin]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
        above, start_above = row, start
    return best


class Items:
    """A block of benchmark items: words as numbers, and the scores they ask for."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(i, t) for i, t in ((i, words_of(t)) for i, t in rows) if t]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, t in texts for w in t), 1)}
        self.ids = [i for i, _ in texts]
        self.items = [np.array([self.vocabulary[w] for w in t], np.int64) for _, t in texts]
        self.flat = np.concatenate(self.items) if texts else np.empty(0, np.int64)
        size = np.array([len(x) for x in self.items], np.int64)
        self.starts = np.cumsum(size) - size
        self.least = np.maximum(np.ceil(MIN_SIMILARITY * MATCH * size), MATCH * np.minimum(N, size)).astype(np.int64)

    def ids_of(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the items of which the text has enough words, wherever they stand."""
        if not len(ids) or not self.items:
            return np.empty(0, np.int64)
        has = np.zeros(len(self.vocabulary) + 1, np.int64)
        has[ids] = MATCH
        has[0] = 0
        return np.flatnonzero(np.add.reduceat(has[self.flat], self.starts) >= self.least)

    def stretches(self, k: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """(first, end) of the parts of the text in which item ``k`` can reach its score."""
        member = np.zeros(len(self.vocabulary) + 1, bool)
        member[self.items[k]] = True
        at = np.flatnonzero(member[ids])
        loss = -max(MISMATCH, GAP)
        # The sum before and after each hit; it starts anew at hits where it would be at its lowest.
        before = (MATCH + loss) * np.arange(len(at)) - loss * at
        after = before + MATCH
        peak = after - np.minimum.accumulate(before)
        if not len(at) or peak.max() < self.least[k]:
            return []
        new = np.flatnonzero(before <= np.minimum.accumulate(before))
        tops = np.maximum.reduceat(peak, new)
        lasts = np.r_[new[1:], len(at)] - 1
        return [(int(at[a]), int(at[z]) + 1) for a, z, top in zip(new, lasts, tops) if top >= self.least[k]]

    def leaks(self, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, end) of the items that a text contains."""
        out = []
        for k in self.candidates(ids).tolist():
            words, best = self.items[k], (int(self.least[k]) - 1, 0, 0)
            for lo, end in self.stretches(k, ids):
                score, first, last = smith_waterman(words, ids[lo:end])
                if score > best[0]:
                    best = (score, lo + first, lo + last)
            if best[2]:
                out.append((self.ids[k], best[0] / (MATCH * len(words)), *best[1:]))
        return out


def fewest_words(least: int, words: int) -> int:
    """Matched words that a score takes when fewer than N of them stand in a row: each run but one costs a loss before it."""
    loss = -max(MISMATCH, GAP)
    for m in range(1, words + 1):
        if MATCH * m - loss * (-(-m // (N - 1)) - 1) >= least:
            return m
    return words + 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of the N-grams inside a text, each with the number of its text."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) for t in texts]
    flat = np.frombuffer(b" ".join(data), np.uint8)
    up, down = _powers(max(20, int(len(flat)).bit_length()))
    edge = np.flatnonzero(np.diff(flat != 0x20, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_LETTER[flat] * up[: len(flat)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(29)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), starts, side="right")
    if len(h) < N:
        return h, owner, np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = h[: len(h) - N + 1].copy()
    for k in range(1, N):
        gram = (gram + h[k : len(h) - N + 1 + k]) * _MIX
        gram ^= gram >> np.uint64(32)
    inside = owner[: len(gram)] == owner[N - 1 :]
    return h, owner, gram[inside], owner[: len(gram)][inside]


def _distinct(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and how often they occur."""
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (h[1:] != h[:-1])][: len(at)])
    return at[first], h[first], np.diff(np.r_[first, len(at)])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes (h): at most BITS / 64 numbers reach the driver."""
    at = F.pmod(F.col("h"), F.lit(BITS))
    rows = hashes.select(F.floor(at / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(64 * len(bitmap))
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _items(bench: DataFrame) -> DataFrame:
    """nr, item_id, text of the items with words; a number for each row, fixed once it is written."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    return common.written(rows.withColumn("nr", F.monotonically_increasing_id()))


def _item_grams(items: DataFrame) -> DataFrame:
    """(nr, n, h, times, words, need, fewer): n-grams of items; how many of the rarest words, counted with repeats, a text must have one of: in any case, and if it shares no N-gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", 1 << 20):
            h, owner, gram, of = _hashes(block.column(1).to_pylist())
            size = np.bincount(owner, minlength=block.num_rows)
            least = np.maximum(np.ceil(MIN_SIMILARITY * MATCH * size), MATCH * np.minimum(N, size)).astype(np.int64)
            need = size - -(-least // MATCH) + 1
            fewer = np.array([max(n - fewest_words(v, n) + 1, 0) for n, v in zip(size.tolist(), least.tolist())], np.int64)
            for n, hashes, at in ((1, h, owner), (N, gram, of)):
                row, values, times = _distinct(at, hashes)
                columns = [block.column(0).take(pa.array(row)), pa.array(np.full(len(row), n)), pa.array(values.view(np.int64)), pa.array(times), *(pa.array(v[row]) for v in (size, need, fewer))]
                yield pa.RecordBatch.from_arrays(columns, names=["nr", "n", "h", "times", "words", "need", "fewer"])

    return items.select("nr", "text").mapInArrow(work, "nr long, n long, h long, times long, words long, need long, fewer long")


def _hits(docs: DataFrame, bitmap: np.ndarray, counted: bool) -> DataFrame:
    """The texts' n-grams in the bitmap: (h, k) counts of each block, or (h, h1, h2) with the text's name."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", 1 << 20):
            h, owner, gram, of = _hashes(block.column(1).to_pylist())
            parts = []
            for hashes, at in ((h, owner), (gram, of)):
                known = _known(shared.value, hashes)
                parts.append(_distinct(at[known], hashes[known]))
            at, flat, _ = map(np.concatenate, zip(*parts))
            if counted:
                values, k = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(k)], names=["h", "k"])
            else:
                row = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), block.column(2).take(row), block.column(3).take(row)], names=["h", "h1", "h2"])

    return docs.mapInArrow(work, "h long, k long" if counted else "h long, h1 long, h2 long")


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(nr, h, weight, required): each item's seeds, from its n-grams and (h, k), in how many texts they occur.

    A text is a candidate where its seeds' weights add up to what is required; an N-gram weighs that much alone.
    """
    seen = grams.join(counts.hint("merge"), "h", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    rarest = Window.partitionBy("nr", "n").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, -1)
    before, word = F.coalesce(F.sum("times").over(rarest), F.lit(0)), F.col("n") == 1
    some = F.col("fewer") > 0  # else no score is reached without an N-gram
    ranked = seen.withColumn("before", before).withColumns({"as_words": word & (F.col("before") < F.col("need") + EXTRA), "as_grams": ~word | (some & (F.col("before") < F.col("fewer") + EXTRA))})
    cost = lambda c: F.sum(F.when(F.col(c), F.col("k")).otherwise(0)).alias(c + "_cost")
    costs = ranked.groupBy("nr").agg(cost("as_words"), cost("as_grams"))
    by_grams = (F.col("as_grams_cost") < F.col("as_words_cost")) & (F.col("words") >= N)
    chosen = F.when(by_grams, F.col("as_grams")).otherwise(F.col("as_words"))
    # Of short items there are not that many words more.
    most = F.when(by_grams, F.col("fewer")).otherwise(F.col("need"))
    required = F.greatest(F.least(F.lit(EXTRA), F.col("words") - most), F.lit(0)) + 1
    out = ranked.join(costs, "nr").where(chosen & (F.col("k") > 0)).select("nr", "h", "times", word.alias("word"), required.alias("required"))
    return out.select("nr", "h", F.when(F.col("word"), F.col("times")).otherwise(F.col("required")).alias("weight"), "required")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(h1, h2, nr): texts, by name, and items whose seeds they have enough of. Repeated texts add up, which lets more through."""
    grams = common.written(_item_grams(items))
    texts = docs.where("text is not null")
    counts = common.written(_hits(texts, _bitmap(grams.select("h").distinct()), True).groupBy("h").agg(F.sum("k").alias("k")))
    chosen = common.written(seeds(grams, counts))
    met = _hits(texts, _bitmap(chosen.select("h").distinct()), False).join(chosen.hint("merge"), "h")
    held = met.groupBy("h1", "h2", "nr").agg(F.sum("weight").alias("weight"), F.max("required").alias("required"))
    pairs = common.written(held.where("weight >= required").select("h1", "h2", "nr"))
    for done in (grams, counts, chosen):
        common.dropped(done)
    return pairs


def _grouped(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(h1, h2, items): a text's candidate items, in groups of about GROUP."""
    many = pairs.groupBy("h1", "h2").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    parted = pairs.join(many.hint("merge"), ["h1", "h2"]).withColumn("g", F.pmod(F.xxhash64("nr"), F.col("groups")))
    full = parted.join(items.hint("merge"), "nr")
    return full.groupBy("h1", "h2", "g").agg(F.collect_list(F.struct("nr", "item_id", "text")).alias("items")).drop("g")


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word: items that documents contain."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _aligned(_keyed(docs), _items(bench)).selectExpr(f"cast(doc_id as {kind}) doc_id", "item_id", "similarity", "first_word", "end_word")


def _aligned(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, h1, h2, item_id, similarity, first_word, end_word."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    groups = common.written(_grouped(candidates(keyed, items), items))
    near = _among(keyed, groups).join(groups.hint("merge"), ["h1", "h2"]).select("doc_id", "h1", "h2", "text", "items")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            got = []
            for k, (text, own) in enumerate(zip(block.column(3).to_pylist(), block.column(4).to_pylist())):
                held = Items([(i["item_id"], i["text"]) for i in sorted(own, key=lambda i: i["nr"])])
                got += [(k, *x) for x in held.leaks(held.ids_of(text))]
            cols = [np.array(c) for c in zip(*got)] if got else [np.empty(0)] * 5
            row = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c).take(row) for c in range(3)), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64())))],
                names=["doc_id", "h1", "h2", "item_id", "similarity", "first_word", "end_word"],
            )

    return near.mapInArrow(find, f"doc_id {kind}, h1 long, h2 long, item_id long, similarity double, first_word long, end_word long")


def _among(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose h1 is in the bitmap of the names', and perhaps some others; nothing is shuffled."""
    return rows.where(_in_bitmap(rows, named)(F.col("h1")))


def _in_bitmap(rows: DataFrame, named: DataFrame):
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(named.select(F.col("h1").alias("h")).distinct()))

    @F.arrow_udf("boolean")
    def known(h1: pa.Array) -> pa.Array:
        return pa.array(_known(shared.value, h1.to_numpy(zero_copy_only=False).view(np.uint64)))

    return known


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    found = common.written(_aligned(_keyed(docs), _items(bench)).select("h1", "h2").distinct())
    names = {"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(7), "text")}
    rows = docs.withColumns(names)
    maybe = _in_bitmap(docs, found)(F.col("__h1"))
    bad = found.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    doubtful = rows.where(maybe).join(bad.hint("merge"), ["__h1", "__h2"], "left_anti")
    return rows.where(~maybe).unionByName(doubtful.select(rows.columns)).drop("__h1", "__h2")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
