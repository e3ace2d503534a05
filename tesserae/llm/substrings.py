"""Repeated substrings by a depth-limited radix sort of suffixes.

Every byte that a string of ``T`` bytes covers which also starts anywhere else is removed.
Suffixes are told apart only through their first ``T`` bytes, by most-significant-digit
passes; suffixes that stay equal through all digits are exactly the repeated windows. A
digit is whatever bytes of the window come next in an order that the window's own content
fixes, so equal windows have equal digits:

1. the ``K``-gram with the smallest hash in the window (its anchor). Neighbouring windows
   share their anchor, so one row stands for a run of windows, not one for each byte;
2. the bytes common to all windows of the run that lie within ``STEP`` offsets of each other;
3. the whole window.

A pass groups rows by digit. A digit with one row ends there: its windows occur once. Where
all rows of a digit agree on the whole text that their windows cover, all these windows are
repeated, and nothing needs to be looked at further. Only one row of each distinct text of a
digit with several goes to the next pass, so copies are not sorted again and again. Digits
are compared by 64-bit hashes, next to a 64-bit hash of the covered text.

Group sizes are found by partial aggregation and rows are marked by joins that adaptive
execution can split, so a digit that a third of all rows share stays distributed. Tables
between passes are written to the shared folder.

Null and empty texts, and texts under ``T`` bytes, keep everything. Repeated rows are copies
of each other, so texts from ``T`` bytes on vanish from both. A text is named by ``doc_id`` and
its own hash, so rows that share an id (or have none) with different texts are told apart. Other
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a window, of an anchor; offsets that share a digit in the second pass.
T, K, STEP = 200, 64, 16
#: Windows worked on at once, which bounds memory for texts of any length.
SEGMENT = 1 << 18

_BASE = 0x9E6C63D0876A9A47
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_ROW = "h long, cls long, doc_id long, text_hash long, first long, n int, lead int"
_NAMES = ["h", "cls", "doc_id", "text_hash", "first", "n", "lead"]
#: What names a text.
_KEY = ["doc_id", "text_hash"]


class Anchors:
    """Runs of windows with one anchor: (hash of the anchor, first window, windows, anchor - first window)."""

    def __init__(self, t: int = T, k: int = K):
        self.t, self.k, n = t, k, SEGMENT + t
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        t, k = self.t, self.k
        for at in range(0, len(data) - t + 1, SEGMENT):
            part = data[at : at + SEGMENT + t - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_LETTERS[part] * self.up[: len(part)], out=sums[1:])
            h = (sums[k:] - sums[:-k]) * self.down[: len(part) - k + 1]
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(32)
            # Smallest upper half, leftmost on ties: one minimum over hash and position.
            low = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
            width, have = t - k + 1, 1
            while have * 2 <= width:
                low = np.minimum(low[:-have], low[have:])
                have *= 2
            if have < width:
                low = np.minimum(low[: have - width], low[width - have :])
            anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            yield h[anchor[first]], at + first, np.diff(first, append=len(anchor)), anchor[first] - first


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)]
    kinds = [np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(cols, kinds)], names=_NAMES)


def anchored(docs: DataFrame, t: int = T, k: int = K) -> DataFrame:
    """First digit of every window of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(t, k)
        for block in common.blocks(batches, "text"):
            parts = []
            for doc, mark, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), common.utf8(block.column(2))):
                for h, first, n, lead in anchors(np.frombuffer(text, np.uint8)):
                    cls = [xxhash.xxh3_64_intdigest(text[a : a + m + t - 1], x) for a, m, x in zip(first.tolist(), n.tolist(), lead.tolist())]
                    parts.append((h, np.array(cls, np.uint64), np.full(len(h), doc, np.int64), np.full(len(h), mark, np.int64), first, n, lead))
            if parts:
                yield _batch(parts)

    return docs.mapInArrow(work, _ROW)


def _deeper(texts: DataFrame, wanted: DataFrame, digits) -> DataFrame:
    """Rows of the next digit for the wanted runs; ``digits(text, first, n, lead)`` yields (digit, covered text's hash, first, n, lead)."""
    runs = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n", "lead")).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", 1 << 20):
            got = []
            for doc, mark, text, mine in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), common.utf8(block.column(2)), block.column(3).to_pylist()):
                got += [(h, c, doc, mark, f, n, x) for run in mine for h, c, f, n, x in digits(text, run["first"], run["n"], run["lead"])]
                if len(got) > 200_000:
                    yield _batch([tuple(np.array(c, np.uint64 if k < 2 else np.int64) for k, c in enumerate(zip(*got)))])
                    got = []
            if got:
                yield _batch([tuple(np.array(c, np.uint64 if k < 2 else np.int64) for k, c in enumerate(zip(*got)))])

    return texts.join(runs, _KEY).select(*_KEY, "text", "runs").mapInArrow(work, _ROW)


def second_digit(t: int = T, step: int = STEP):
    def digits(text: bytes, first: int, n: int, lead: int):
        anchor, at = first + lead, first
        while at < first + n:
            group = (anchor - at) // step
            nearest = anchor - group * step  # the group's last window, if all its windows are in the run
            end = min(first + n, nearest + 1)
            core = text[nearest : nearest - step + 1 + t]
            yield xxhash.xxh3_64_intdigest(core, group), xxhash.xxh3_64_intdigest(text[at : end + t - 1], anchor - at), at, end - at, anchor - at
            at = end

    return digits


def last_digit(t: int = T):
    def digits(text: bytes, first: int, n: int, lead: int):
        for at in range(first, first + n):
            both = xxhash.xxh3_128_intdigest(text[at : at + t])
            yield both & 0xFFFFFFFFFFFFFFFF, both >> 64, at, 1, 0

    return digits


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: (runs of repeated windows; one run for each text of digits with several texts)."""
    shared = rows.groupBy("h").agg(F.count("*").alias("k"), F.min("cls").alias("a"), F.max("cls").alias("b")).where("k > 1").select("h", F.expr("a <> b").alias("several"))
    # Written and merged, so that both sides are plain exchanges, which adaptive execution can split, at every size.
    kept = common.written(rows.join(common.written(shared).hint("merge"), "h"))
    several = kept.where("several")
    texts = several.groupBy("h", "cls").agg(F.count("*").alias("k"), F.min(F.struct(*_KEY, "first", "n", "lead")).alias("one"))
    texts = common.written(texts)
    alike = several.join(texts.where("k > 1").select("h", "cls"), ["h", "cls"])
    return kept.where("not several").select(*_KEY, "first", "n").unionAll(alike.select(*_KEY, "first", "n")), texts.select("one.*")


def repeated(texts: DataFrame, t: int = T, k: int = K, step: int = STEP) -> DataFrame:
    """(doc_id, text_hash, first, n): runs of windows that occur elsewhere too; ``texts`` has doc_id (no nulls), text_hash and text."""
    found, open_runs = split(anchored(texts, t, k))
    more, open_windows = split(common.written(_deeper(texts, open_runs, second_digit(t, step))))
    last, _ = split(common.written(_deeper(texts, open_windows, last_digit(t))))
    return found.unionAll(more).unionAll(last)


def deduplicated(docs: DataFrame, t: int = T, k: int = K, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, ``removed`` (maximal spans, end exclusive) and ``kept`` (binary) of each row."""
    none = -(1 << 63)
    common.shipped(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce("doc_id", F.lit(none)).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    runs = repeated(texts, t, k, step).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            sizes, spans, kept = [], [], []
            for text, mine in zip(common.utf8(block.column(1)), block.column(2)):
                sizes.append(len(text))
                if not mine.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                first, n = (mine.values.field(c).to_numpy() for c in ("first", "n"))
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, first, 1)
                np.subtract.at(change, np.minimum(first + n - 1 + t, len(text)), 1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans.append([{"first": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    out = texts.join(runs, _KEY, "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<first:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(none)))


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
