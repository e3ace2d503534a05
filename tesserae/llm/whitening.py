"""Whitening of embeddings from exact integer statistics.

Each entry c becomes the integer x = floor(1024 c) + 100000. Sums and cross-products are
accumulated exactly: every task subtracts the shift of 100000 from its vectors, multiplies
blocks of them (in limbs small enough that float64 products and their sums are exact), adds
up in integers of any size, and hands over each sum in limbs of 40 bits, which Spark adds per
matrix cell. From the n vectors, their sums S and cross-products, n XᵀX - SSᵀ is formed in
integers, which no shift changes; only then does it become floating point, as the correctly
rounded quotient by n², and is decomposed by ``eigh``. What reaches the driver is one matrix,
whose size depends on the dimension alone.

``moments`` are per task; their merge and that of the whitened columns' own covariance (each task's
count, means and centred products, then the parts between tasks) run in Spark.

Rows are dropped when the vector is null, holds null or non-finite entries, or has not the
fit list's dimension: the most frequent length above 0 (of several, the longest). An integer
beyond 63 bits is clamped to them. Repeated rows count as often as they occur; null and repeated
vec_ids are kept. Components of variance 0 (or of less than rounding leaves of it) have ``whitened`` null
and are left out of ``identity_error``; ``deviation`` is null where it exceeds a long,
``deviation_exact`` always has its digits. Other columns are not read; an empty table, and one
without usable vectors, give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Bits of a limb that a task hands over: sums of 2^22 tasks fit a long.
LIMB = 40
#: Bits of a limb inside a task, and rows multiplied at once: products of 2^40 add up below 2^53.
PART, ROWS = 20, 4096
_CLAMP = float(2**62)


def matrix(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and their entries as float64 rows (of ``dimension`` entries if given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    offsets = column.offsets.to_numpy()[:-1]
    values = column.values
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    clean = bad[offsets + lengths] == bad[offsets]
    usable = clean & (lengths > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    if dimension is None:
        return np.flatnonzero(usable), lengths
    at = np.flatnonzero(usable & (lengths == dimension))
    return at, numbers[offsets[at][:, None] + np.arange(dimension)[None, :]] if len(at) else np.empty((0, dimension))


def integers(entries: np.ndarray) -> np.ndarray:
    """x - SHIFT of each entry: floor(1024 c), clamped to 62 bits."""
    return np.clip(np.floor(entries * SCALE), -_CLAMP, _CLAMP).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """xᵀx of int64 rows (at most ROWS of them), exact, as Python integers."""
    assert len(x) <= ROWS
    limbs, rest = [], x
    while True:
        low = rest & ((1 << PART) - 1) if np.abs(rest).max(initial=0) >= 1 << PART else rest
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> PART
        if not rest.any():
            break
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (PART * (i + j))
    return total


def in_limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, part): parts whose sum, each shifted by its limb, is the value; all but the last are from 0 to 2^LIMB."""
    limb = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield limb, value & ((1 << LIMB) - 1)
        value >>= LIMB
        limb += 1
    yield limb, value


def dimension_of(rows: DataFrame) -> int | None:
    """The most frequent length of usable vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths = matrix(batch.column(0))
            sizes, counts = np.unique(lengths[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["size", "k"])

    counted = rows.select("embedding").mapInArrow(work, "size long, k long").groupBy("size").agg(F.sum("k").alias("k"))
    best = counted.orderBy(F.desc("k"), F.desc("size")).first()
    return best and best["size"]


def moments(rows: DataFrame, dimension: int) -> DataFrame:
    """(i, j, limb, part): sums of the fit list's integers. i = j = -1: n; j = -1: sum of i; else cross-product."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            _, entries = matrix(batch.column(0), dimension)
            for k in range(0, len(entries), ROWS):
                x = integers(entries[k : k + ROWS])
                n += len(x)
                sums += x.astype(object).sum(0) if np.abs(x).max() >= 1 << 50 else x.sum(0).astype(object)
                cross += products(x)
        if not n:
            return
        out = [(-1, -1, *p) for p in in_limbs(n)] + [(i, -1, *p) for i in range(dimension) for p in in_limbs(int(sums[i]))]
        out += [(i, j, *p) for i in range(dimension) for j in range(i, dimension) for p in in_limbs(int(cross[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["i", "j", "limb", "part"])

    cells = rows.select("embedding").mapInArrow(work, "i long, j long, limb long, part long")
    return cells.groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  # of x - SHIFT
    scatter: np.ndarray  # n XᵀX - SSᵀ, Python integers
    values: np.ndarray  # eigenvalues of V, falling
    vectors: np.ndarray  # columns

    @property
    def trace(self) -> float:
        return sum(int(self.scatter[k, k]) for k in range(len(self.sums))) / (self.n * self.n)

    @property
    def kept(self) -> int:
        return min(COMPONENTS, len(self.sums))

    def real(self, k: int) -> bool:
        """Whether component k (from 0) has more variance than rounding leaves of none."""
        return bool(self.values[k] > self.values[0] * len(self.sums) * np.finfo(float).eps)


def decomposed(n: int, sums: list[int], cross: np.ndarray) -> Fit:
    scatter = n * cross - np.outer(np.array(sums, object), np.array(sums, object))
    v = np.array([[int(c) / (n * n) for c in row] for row in scatter])
    values, vectors = np.linalg.eigh(v)
    return Fit(n, sums, scatter, values[::-1].copy(), vectors[:, ::-1].copy())


def fitted(rows: DataFrame) -> Fit | None:
    dimension = dimension_of(rows)
    if dimension is None:
        return None
    total: dict[tuple[int, int], int] = {}
    for r in moments(rows, dimension).toLocalIterator():
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["part"] << (LIMB * r["limb"]))
    cross = np.array([[total[min(i, j), max(i, j)] for j in range(dimension)] for i in range(dimension)], object)
    return decomposed(total[-1, -1], [total[i, -1] for i in range(dimension)], cross)


class Projector:
    """Whitened components and exact deviations of entries."""

    def __init__(self, fit: Fit):
        self.fit, self.sums = fit, np.array(fit.sums, object)
        n = fit.n
        # x - S/n = (x - whole) - part, where whole is an integer: no digits are lost where all entries are large.
        self.whole = np.array([s // n for s in fit.sums], np.int64)
        self.part = np.array([(s - n * (s // n)) / n for s in fit.sums])
        real = [fit.real(k) for k in range(fit.kept)]
        self.real = np.array(real)
        self.axes = fit.vectors[:, : fit.kept] / np.sqrt(np.where(real, fit.values[: fit.kept], 1.0))
        self.small = max(abs(s) for s in fit.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        far = np.abs(x).max(initial=0) >= 1 << 60
        away = (x.astype(object) - self.whole.astype(object)).astype(float) if far else (x - self.whole).astype(np.float64)
        return (away - self.part) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        n, most = self.fit.n, int(np.abs(x).max(initial=0))
        bound = n * most + self.small
        if bound * bound * x.shape[1] < 1 << 63:
            d = n * x - self.sums.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = n * x.astype(object) - self.sums
        return (d * d).sum(1).tolist()


def identity_error(rows: DataFrame, fit: Fit) -> float | None:
    """Largest entry of the whitened covariance minus the identity; from the rows, centred before multiplying."""
    k = fit.kept

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projector(fit)
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, entries = matrix(batch.column(0), len(fit.sums))
            if not len(entries):
                continue
            w = project.whitened(integers(entries))
            here, at = len(w), w.mean(0)
            apart = at - mean
            m2 += (w - at).T @ (w - at) + np.outer(apart, apart) * (n * here / (n + here))
            mean += apart * (here / (n + here))
            n += here
        if n:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, m2[i, j], mean[i], mean[j], np.full(len(i), n))], names=["i", "j", "m2", "mi", "mj", "n"])

    parts = common.written(rows.select("embedding").mapInArrow(work, "i long, j long, m2 double, mi double, mj double, n long"))
    means = parts.groupBy("i", "j").agg((F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("ci"), (F.sum(F.col("mj") * F.col("n")) / F.sum("n")).alias("cj"))
    between = (F.col("mi") - F.col("ci")) * (F.col("mj") - F.col("cj")) * F.col("n")
    cells = parts.join(F.broadcast(means), ["i", "j"]).groupBy("i", "j").agg((F.sum(F.col("m2") + between) / F.sum("n")).alias("v"))
    real = [c for c in range(k) if fit.real(c)]
    got = [abs(r["v"] - (r["i"] == r["j"])) for r in cells.collect() if r["i"] in real and r["j"] in real]
    common.dropped(parts)
    return max(got, default=None)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def whitened(rows: DataFrame) -> DataFrame:
    """One row for each usable vector and component; columns as in SCHEMA."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = fitted(rows)
    if fit is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error, trace, k = identity_error(rows, fit), fit.trace, fit.kept
    explained = [max(float(e), 0.0) / trace if trace else 0.0 for e in fit.values[:k]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projector(fit)
        for batch in batches:
            at, entries = matrix(batch.column(1), len(fit.sums))
            if not len(at):
                continue
            x = integers(entries)
            w, d = project.whitened(x), project.deviations(x)
            each = pa.array(np.repeat(np.arange(len(at)), k))
            one = lambda v, t: pa.array(v, t).take(each)
            flat = pa.array(w.ravel(), mask=np.tile(~project.real, len(at)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(w) * k, fit.n)),
                    one([v if v < 1 << 63 else None for v in d], pa.int64()),
                    flat,
                    pa.array(np.tile(explained, len(at))),
                    pa.array([error] * (len(w) * k), pa.float64()),
                    one([str(v) for v in d], pa.string()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return rows.mapInArrow(work, SCHEMA)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(common.table(spark, sf_dir, "embeddings"))
