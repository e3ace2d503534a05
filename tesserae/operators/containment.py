"""Which texts hold which strings, without comparing each text to each string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of the bitmap of keys, as a power of two. It only spares rows; what it lets through is compared.
BITS = 26
_BLOCK = 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def part_of(n: int) -> int:
    """The leading characters of a string of ``n`` that are its key: all of a short one, at least four fifths of a longer one."""
    part = min(n, 16)
    while part >= 16 and part + max(part // 4, 1) <= n:
        part += part // 4
    return part


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base, mod = 0x2545F4914F6CDD1D, 1 << 64
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, mod), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all substrings of a length, by sums that start at the text's beginning."""

    def __init__(self) -> None:
        self.powers = _powers(1 << 12)

    def sums(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) >= len(self.powers[0]):
            self.powers = _powers(2 * len(codes))
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed((codes + np.uint64(1)) * _STEP) * self.powers[0][: len(codes)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, part: int, seed: np.uint64) -> np.ndarray:
        n = max(len(sums) - part, 0)
        return _mixed(((sums[part:] - sums[:n]) * self.powers[1][:n]) ^ seed) if part else np.full(1, _mixed(np.full(1, seed))[0])


def _seed(owner: str, part: int) -> np.uint64:
    import zlib

    return np.uint64((zlib.crc32(owner.encode("utf-8", "surrogatepass")) << 32) | part)


def _keys(strings: DataFrame) -> DataFrame:
    """(owner, text, part, hash) of strings (owner, text)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            owners, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            parts = [part_of(len(t)) for t in texts]
            found = [int(hashes.of(hashes.sums(t[:p]), p, _seed(o, p))[0].astype(np.int64)) for o, t, p in zip(owners, texts, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(texts, pa.string()), pa.array(parts, pa.int32()), pa.array(found, pa.int64())], ["owner", "text", "part", "hash"])

    return strings.mapInArrow(keyed, "owner string, text string, part int, hash long")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each key's hash: blocks made by Spark, at most 8 MB together."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    blocks = keys.select(F.shiftright(place, _BLOCK).alias("block"), place.bitwiseAND((1 << _BLOCK) - 1).cast("int").alias("bit"))
    rows = blocks.groupBy("block").agg(F.array_sort(F.collect_set("bit")).alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bits in b.column(1).to_pylist():
                flags = np.zeros(1 << _BLOCK, np.uint8)
                flags[bits] = 1
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["block", "packed"])

    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for r in rows.mapInArrow(packed, "block long, packed binary").toLocalIterator():
        bitmap[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.packed), np.uint8)
    return bitmap


def held(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(owner, id, string): which texts (owner, id, text) hold which strings (owner, string) of the same owner, each pair once.

    A string's key is the hash of its first characters. Of a text, all substrings of the lengths that keys have are hashed;
    those whose hash is a key's are joined to it, and the string is compared there. So the rows joined are what is found,
    and strings that go on in another way. An empty string stands in every text.
    """
    from ..shared import written

    spark = texts.sparkSession
    plain = strings.where("owner IS NOT NULL AND string IS NOT NULL").select(F.col("owner").cast("string").alias("owner"), F.col("string").alias("text")).distinct()
    keys = written(_keys(plain))
    longest = {r.part: r.longest for r in keys.groupBy("part").agg(F.max(F.length("text")).alias("longest")).collect()}
    bitmap = spark.sparkContext.broadcast(_bitmap(keys))
    id_type = texts.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), bitmap.value
        for b in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            ids = b.column(1)
            for k, (owner, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                sums = hashes.sums(text)
                for part, most in longest.items():
                    h = hashes.of(sums, part, _seed(owner, part))
                    place = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    for p in np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1):
                        for column, v in zip(out, (k, owner, part, int(h[p].astype(np.int64)), text[p : p + most]), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.string()), ids.take(pa.array(out[0], pa.int64())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], ["owner", "id", "part", "hash", "piece"])

    rows = texts.where("owner IS NOT NULL AND text IS NOT NULL").select(F.col("owner").cast("string").alias("owner"), "id", "text")
    # A small file is one task's, however long its texts take.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.repartition(tasks).mapInArrow(found, f"owner string, id {id_type}, part int, hash long, piece string")
    return pieces.join(keys, ["owner", "part", "hash"]).where(F.startswith("piece", "text")).select("owner", "id", F.col("text").alias("string")).distinct()
