"""BPE encoding and decoding by speculation and verification.

Greedy longest-match proposes the tokens of each new word. A sequence of tokens is what
merging by rank would give exactly when every adjacent pair of it, merged alone, gives
that pair again; so the distinct adjacent pairs of a batch of words are looked up in one
vectorised pass, unknown pairs are merged once and remembered, and only words with a
failing pair are merged exactly (heap of ranked pairs over a linked list, n log n).

Null and empty texts give no tokens and an empty decoded text. Rows are independent:
repeated rows give equal rows, an empty table gives an empty table; other columns,
whatever their names, pass through ``encoded`` only when they are asked for in ``keep``.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct words a worker remembers before it forgets them and starts again.
CACHE_WORDS = 400_000
#: Words longer than this are never remembered.
CACHE_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


def recent_letters() -> str:
    """Ranges of code points that Python's older Unicode tables lack: libraries may differ on them."""
    lacking = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(lacking.astype(np.int8), prepend=0, append=0)).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


class WordBpe:
    """A word-level BPE vocabulary file: mid-word and word-end pieces, ranked merges."""

    def __init__(self, spec: dict):
        from tokenizers import Regex, normalizers, pre_tokenizers

        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.pieces = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.pieces[i] = piece
        self.special = {}
        for t in spec["added_tokens"]:
            self.pieces[t["id"]] = t["content"]
            self.special[t["content"]] = t["id"]
        self.vocab = vocab
        self.mid = {p: i for p, i in vocab.items() if not p.endswith(self.suffix)}
        self.end = {p[: -len(self.suffix)]: i for p, i in vocab.items() if p.endswith(self.suffix)}
        self.longest = max(map(len, [*self.mid, *self.end]))
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.letters = byte_letters()
        self.table = str.maketrans({chr(b): self.letters[b] for b in range(256)})
        self.beyond = re.compile("[\u0378-\U0010ffff]")  # Python's tables are whole below
        self.norm = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.unknown = regex.compile(f"[{recent_letters()}]")
        self.newer = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs = np.empty(0, np.int64)  # sorted: left << 32 | right
        self.pairs_ok = np.empty(0, bool)
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    # -- exact merging ---------------------------------------------------------
    def merged(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [x for x in ids if x >= 0]

    def symbols(self, letters: str, ends: bool = True) -> list[int]:
        vocab = self.vocab
        out = [vocab[c] for c in letters]
        if ends and letters:
            out[-1] = vocab[letters[-1] + self.suffix]
        return out

    # -- speculation -----------------------------------------------------------
    def proposed(self, letters: str) -> list[int]:
        out, at, n, mid = [], 0, len(letters), self.mid
        while at < n:
            rest = n - at
            if rest <= self.longest and (i := self.end.get(letters[at:])) is not None:
                out.append(i)
                break
            for size in range(min(self.longest, rest - 1), 0, -1):
                if (i := mid.get(letters[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                raise ValueError(f"no piece for {letters[at]!r}")
        return out

    # -- verification ----------------------------------------------------------
    def _keeps(self, *ids: int) -> bool:
        """Do these pieces, merged from single letters, come out as they are?"""
        parts = []
        for i in ids:
            p = self.pieces[i]
            ends = p.endswith(self.suffix)
            parts += self.symbols(p[: -len(self.suffix)] if ends else p, ends)
        return self.merged(parts) == list(ids)

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For pairs left << 32 | right: whether they stay apart and whole."""
        new = np.unique(keys)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)
            new = new[self.pairs[at] != new]
        if len(new):
            ok = np.array([self._keeps(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.pairs_ok = np.insert(self.pairs, at, new), np.insert(self.pairs_ok, at, ok)
        return self.pairs_ok[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of distinct words."""
        letters = [w.encode().decode("latin-1").translate(self.table) for w in words]
        guess = [self.proposed(x) for x in letters]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        last = np.zeros(len(flat), bool)
        last[starts + sizes - 1] = True
        left = np.flatnonzero(~last)
        good = np.ones(len(flat), bool)
        if len(left):
            good[left] = self.compatible(flat[left] << 32 | flat[left + 1])
        good = np.logical_and.reduceat(good, starts)
        for k in np.flatnonzero(sizes == 1).tolist():
            i = guess[k][0]
            if i not in self.alone:
                self.alone[i] = self._keeps(i)
            good[k] = self.alone[i]
        for k in np.flatnonzero(~good).tolist():
            guess[k] = self.merged(self.symbols(letters[k]))
        return {w: np.array(g, "<u4").tobytes() for w, g in zip(words, guess)}

    # -- texts -----------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.beyond.search(text) and self.unknown.search(text):
            return [w for w, _ in self.newer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        runs: list[list] = []
        for text in texts:
            pieces = self.cut.split(text) if self.cut and "<|" in text else [text]
            runs.append([p if i % 2 else self.split(self.norm.normalize_str(p)) for i, p in enumerate(pieces) if p])
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        own, cache = {}, self.cache
        new = {w for run in runs for part in run if not isinstance(part, str) for w in set(part) if w not in cache}
        if new:
            new = list(new)
            for a in range(0, len(new), 20_000):
                for w, ids in self.learn(new[a : a + 20_000]).items():
                    (cache if len(w) <= CACHE_LENGTH else own)[w] = ids
        out = []
        for run in runs:
            got = []
            for part in run:
                if isinstance(part, str):
                    got.append(self.special[part].to_bytes(4, "little"))
                elif own:
                    got += [own[w] if w in own else cache[w] for w in part]
                else:
                    got += map(cache.__getitem__, part)
            out.append(b"".join(got))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (binary: little-endian unsigned 32-bit integers) and, if asked for, ``decoded``.

    The vocabulary (a few MB, fixed) goes to the workers as one broadcast variable, so the
    file need not exist on executors. No shuffle: a row's result depends on the row alone.
    """
    spark = docs.sparkSession
    common.shipped(spark)
    spec = spark.sparkContext.broadcast(load(path or default_path()))
    columns = [F.col(f"`{c}`") for c in keep]
    kept = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = docs.select(*columns).schema.add("ids", "binary", False)
    if decode:
        schema = schema.add("decoded", "string", False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for block in common.blocks(batches, "__text", 1 << 20):
            bpe = bpe or WordBpe(spec.value)
            ids = bpe.encode(block.column(block.num_columns - 1).to_pylist())
            cols = [*block.columns[:-1], pa.array(ids, pa.binary())]
            if decode:
                cols.append(pa.array(map(bpe.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*block.schema.names[:-1], "ids", "decoded"][: len(cols)])

    return kept.mapInArrow(work, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    out = encoded(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
