"""Alignment of two tokenizers: where their tokens end together, and which ids meet there.

A is a byte-level BPE over space+text, B a sentencepiece BPE over the text, to which it adds the
space. Byte offsets at which tokens of both end cut the bytes into groups; every A token of a
group is linked with every B token of it. An id pair's count is the number of documents that
hold it linked.

1. Texts are cut into units where white space follows a character that is none. No token of A crosses
   such a place; white space that B's vocabulary joins to what stands before it cuts nothing. So
   units are tokenised alone, once for each block of texts, and unit ends are group ends.
2. For each block, an Arrow partition's piece of about ``BLOCK`` bytes of text, DuckDB takes the
   token intervals of its distinct units: tokens that end together are cuts, window sums over the
   cuts number the groups of A's tokens, an ASOF join takes each B token to its group, and tokens
   meet by group. Ids that repeat in a group are counted before they meet.
3. The links of units and how often each document holds them give the links of documents. A block
   keeps its distinct id pairs with the number of its documents; Spark adds these partial counts up
   for the corpus and finds each A id's highest.
4. The totals of its pairs go back to each block, by block, where they are added over the links.
   So an id pair that every document holds is one row a block, and no row is made for a pair of
   tokens.

Null and empty texts, texts that are not UTF-8, and texts whose joined token bytes differ from
space+text in A or B (such as those with U+2581) have no tokens: zeros, and '' for the hash.
A document is a row: repeated rows and repeated or null ids count and stay as rows. Other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters

#: Bytes of text of a block. A longer text is a block of its own.
BLOCK = 4 << 20
#: Letters of units that are encoded at once.
RUN = 1 << 14
DUCKDB_MEMORY = "1GB"

SPACE = "▁"


def vocabulary_a(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    entries = dict(found["model"]["vocab"]) | {t["content"]: t["id"] for t in found.get("added_tokens", ())}
    out = [b""] * (max(entries.values()) + 1)
    for piece, i in entries.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def vocabulary_b(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece vocabulary with byte fallback."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.replace(SPACE, " ").encode())
            if re.search(rf"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"piece {piece!r} crosses the start of a word")
    return out


def unit_pattern(model) -> re.Pattern:
    """White space and what follows it, up to white space that no piece of B joins to other characters."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    joined = {c for p in pieces if len(p) > 1 for c in p if c.isspace()}
    more = f"(?:[{re.escape(''.join(sorted(joined)))}]\\s*\\S*)*" if joined else ""
    return re.compile(r"\s+\S*" + more)


class Tokenizers:
    """Ids of units in both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space, self.units = self.b.piece_to_id(SPACE), unit_pattern(self.b)
        self.bytes_a, self.bytes_b = vocabulary_a(path_a), vocabulary_b(self.b)
        self.width_a, self.width_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))

    def __call__(self, units: list[str]) -> tuple[pa.Table, pa.Table, np.ndarray]:
        """Token intervals (unit, pos, id, e) of both, for the units whose bytes both give back; and which units those are.

        Units that end in white space, which only ends of texts do, are encoded alone. The others stand one
        after the other in longer texts, as in documents; if such a text's tokens do not give back its
        bytes, its units are encoded alone too.
        """
        good = np.zeros(len(units), bool)
        found: tuple[list, list] = ([], [])  # (unit of each token, ids)
        alone = [k for k, u in enumerate(units) if u[-1].isspace()]
        rest = [k for k, u in enumerate(units) if not u[-1].isspace()]
        cuts = np.cumsum([len(units[k]) for k in rest]) // RUN
        cuts = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(rest)]
        runs = [rest[i:j] for i, j in zip(cuts, cuts[1:]) if i < j]
        texts = ["".join(units[k] for k in run) for run in runs]
        for run, text, ids in zip(runs, texts, zip(*self._encoded(texts))):
            ends = np.cumsum([len(units[k].encode()) for k in run])
            at = [np.cumsum(w[x]) for w, x in zip((self.width_a, self.width_b), ids)]
            if self._whole(text, *ids) and all(np.isin(ends, e).all() for e in at):
                good[run] = True
                for side, x, e in zip(found, ids, at):
                    side.append((np.asarray(run)[np.searchsorted(ends, e)], x))
            else:
                alone += run
        for k, ids in zip(alone, zip(*self._encoded([units[k] for k in alone]))):
            if self._whole(units[k], *ids):
                good[k] = True
                for side, x in zip(found, ids):
                    side.append((np.full(len(x), k), x))
        return *(self._intervals(side, w) for side, w in zip(found, (self.width_a, self.width_b))), good

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        one = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B adds a space: it stands for the text's first one, or goes again. It adds none to an empty text.
        two = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return one, [[self.space] if t == " " else x if t[0] == " " else x[1:] for t, x in zip(texts, two)]

    def _whole(self, text: str, a: list[int], b: list[int]) -> bool:
        want = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    @staticmethod
    def _intervals(found: list, width: np.ndarray) -> pa.Table:
        unit, ids = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        order = np.argsort(unit, kind="stable")
        unit, ids = unit[order], ids[order]
        return pa.table({"pos": np.arange(len(ids)), "unit": unit, "id": ids, "e": np.cumsum(width[ids])})


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizers(path_a, path_b)


#: Token intervals a and b (unit, pos, id, e): bytes of all units stand one after the other, so an end e names its unit too.
GROUPS = """
CREATE OR REPLACE TEMP TABLE ta AS SELECT pos, unit, id, e FROM a;
CREATE OR REPLACE TEMP TABLE tb AS SELECT pos, unit, id, e FROM b;
CREATE OR REPLACE TEMP TABLE marked AS
  SELECT ta.pos, ta.unit, ta.id, ta.e, (tb.e IS NOT NULL)::INT AS cut FROM ta LEFT JOIN tb ON ta.e = tb.e;
CREATE OR REPLACE TEMP TABLE ga AS
  SELECT pos, unit, id, e, cut, coalesce(sum(cut) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM marked;
CREATE OR REPLACE TEMP TABLE gb AS
  SELECT tb.pos, tb.unit, tb.id, c.g FROM tb ASOF JOIN (SELECT e, g FROM ga WHERE cut = 1) c ON tb.e <= c.e;
CREATE OR REPLACE TEMP TABLE unit_links AS
  SELECT x.unit, x.id AS a, y.id AS b, sum(x.k * y.k)::BIGINT AS m
  FROM (SELECT unit, g, id, count(*) AS k FROM ga GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS k FROM gb GROUP BY ALL) y ON x.g = y.g
  GROUP BY ALL;
"""
LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
  SELECT h.doc, u.a, u.b, sum(h.k * u.m)::BIGINT AS m FROM held h JOIN unit_links u ON h.unit = u.unit GROUP BY ALL;
CREATE OR REPLACE TEMP TABLE pairs AS
  SELECT a, b, k, (row_number() OVER (ORDER BY a, b) - 1)::INT AS nr FROM (SELECT a, b, count(*) AS k FROM links GROUP BY ALL);
"""


def _digits(a: dict[str, np.ndarray], b: dict[str, np.ndarray], units: int) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each unit, from unit, id and g of its tokens in order."""
    unit, g = (np.concatenate([a[c], b[c]]) for c in ("unit", "g"))
    side = np.repeat([0, 1], [len(a["id"]), len(b["id"])])
    order = np.lexsort([side, g])  # a stable sort: tokens of a side stay in order
    ids, unit, g, side = np.concatenate([a["id"], b["id"]])[order], unit[order], g[order], side[order]
    last = np.ones(len(g), bool)
    last[:-1] = (g[1:] != g[:-1]) | (side[1:] != side[:-1])
    mark = np.where(last, np.where(side == 0, "|", ";"), ",")
    words = [x + y for x, y in zip(map(str, ids.tolist()), mark.tolist())]
    cuts = np.searchsorted(unit, np.arange(units + 1)).tolist()
    return ["".join(words[i:j])[:-1] for i, j in zip(cuts, cuts[1:])]


class _Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = len(self)
        return self[key]


def aligned(texts: list[bytes], models: Tokenizers, con) -> tuple[dict[str, list], pa.Table]:
    """Per text n_a, n_b, n_groups, n_links, groups_sha256, and pairs (numbers of the block's pairs) with times; and the block's pairs (a, b, k) in their order."""
    index = _Numbers()
    codes: list[np.ndarray] = []
    for t in texts:
        try:
            found = models.units.findall(" " + t.decode()) if t else []
        except UnicodeDecodeError:
            found = []
        codes.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
    units = list(index)
    a, b, good = models(units)
    con.register("a", a)
    con.register("b", b)
    con.execute(GROUPS)
    digits = _digits(*(con.execute(f"SELECT unit, id, g FROM {t} ORDER BY pos").fetchnumpy() for t in ("ga", "gb")), len(units))
    per_unit = np.zeros((4, len(units)), np.int64)
    per_unit[0], per_unit[1] = (np.bincount(t["unit"].to_numpy(), minlength=len(units)) for t in (a, b))
    for row, sql in ((2, "SELECT unit, count(DISTINCT g) AS v FROM ga GROUP BY unit"), (3, "SELECT unit, sum(m)::BIGINT AS v FROM unit_links GROUP BY unit")):
        got = con.execute(sql).to_arrow_table()
        per_unit[row, got["unit"].to_numpy()] = got["v"].to_numpy()

    usable = [bool(len(c)) and bool(good[c].all()) for c in codes]
    docs, held, times = [], [], []
    for k, (c, ok) in enumerate(zip(codes, usable)):
        if ok:
            u, n = np.unique(c, return_counts=True)
            docs.append(np.full(len(u), k))
            held.append(u)
            times.append(n)
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, held, times)]
    con.register("held", pa.table(dict(zip(("doc", "unit", "k"), flat))))
    con.execute(LINKS)
    links = con.execute("SELECT l.doc, p.nr, l.m FROM links l JOIN pairs p ON l.a = p.a AND l.b = p.b ORDER BY l.doc, p.nr").to_arrow_table()
    pairs = con.execute("SELECT a, b, k FROM pairs ORDER BY nr").to_arrow_table()
    for name in ("a", "b", "held"):
        con.unregister(name)

    bounds = np.searchsorted(links["doc"].to_numpy(), np.arange(len(texts) + 1)).astype(np.int32)
    out: dict = {n: [int(per_unit[r, c].sum()) if ok else 0 for c, ok in zip(codes, usable)] for r, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    out["groups_sha256"] = [hashlib.sha256(";".join(map(digits.__getitem__, c.tolist())).encode()).hexdigest() if ok else "" for c, ok in zip(codes, usable)]
    for name, column, kind in (("pairs", "nr", pa.int32()), ("times", "m", pa.int64())):
        out[name] = pa.ListArray.from_arrays(pa.array(bounds), links[column].combine_chunks().cast(kind) if links.num_rows else pa.array([], kind))
    return out, pairs


_DOC = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"
#: A block's documents, and in one row of its own (doc_id null, pairs null) its pairs.
_BLOCKS = _DOC + ", own boolean, a array<int>, b array<int>, k array<int>"


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows as in _BLOCKS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        models = tokenizers(path_a, path_b)
        con = duckdb.connect(config={"threads": "1", "memory_limit": DUCKDB_MEMORY})
        first = TaskContext.get().partitionId() << 32
        schema = pa.schema(
            [("block", pa.int64()), ("doc_id", pa.int64())]
            + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("own", pa.bool_())]
            + [(n, pa.list_(pa.int32())) for n in "abk"]
        )

        def one(nr: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            found, pairs = aligned(texts, models, con)
            n = len(ids)
            head = [pa.array([first | nr] * n, pa.int64()), pa.array(ids, pa.int64())]
            body = [found[c] if isinstance(found[c], pa.Array) else pa.array(found[c], schema.field(c).type) for c in schema.names[2:9]]
            tail = [pa.array([True] * n), *(pa.nulls(n, pa.list_(pa.int32())) for _ in "abk")]
            yield pa.RecordBatch.from_arrays([*head, *body, *tail], schema=schema)
            if pairs.num_rows:
                lists = [pa.ListArray.from_arrays(pa.array([0, pairs.num_rows], pa.int32()), pairs[c].combine_chunks().cast(pa.int32())) for c in "abk"]
                empty = [pa.nulls(1, schema.field(c).type) for c in schema.names[1:9]]
                yield pa.RecordBatch.from_arrays([pa.array([first | nr], pa.int64()), *empty, pa.array([False]), *lists], schema=schema)

        nr, ids, texts, size = 0, [], [], 0
        for part in common.blocks(batches, "text", BLOCK):
            for i, t in zip(part.column(0).to_pylist(), common.utf8(part.column(1))):
                if ids and size + len(t) > BLOCK:
                    yield from one(nr, ids, texts)
                    nr, ids, texts, size = nr + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield from one(nr, ids, texts)

    return docs.mapInArrow(work, _BLOCKS)


def _summed(docs: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to documents, from their block's rows (of, a, b, total, best)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.lexsort([right["b"].to_numpy(), right["a"].to_numpy()])
        total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order]
        sizes = np.diff(left["pairs"].combine_chunks().offsets.to_numpy())
        nr, times = (left[c].combine_chunks().flatten().to_numpy() for c in ("pairs", "times"))
        row = np.repeat(np.arange(left.num_rows), sizes)
        sums = []
        for value in (best, total):
            add = np.zeros(left.num_rows, np.int64)
            if len(nr):
                np.add.at(add, row, value[nr].astype(np.int64) * times)
            sums.append(add)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [*(left[c] for c in names), pa.array(sums[0]), pa.array(sums[1]), left["groups_sha256"]]
        return pa.table(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return docs.groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(work, schema)


def pair_counts(partial: DataFrame) -> DataFrame:
    """(a, b, total, best): documents of each pair, and whether they are the most of its a; from rows (a, b, k)."""
    totals = partial.groupBy("a", "b").agg(F.sum("k").alias("total"))
    most = totals.groupBy("a").agg(F.max("total").alias("most"))
    return totals.join(most, "a").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = common.written(blocks(texts, path_a, path_b), 200)
    partial = made.where("NOT own").select(F.col("block").alias("of"), F.explode(F.arrays_zip("a", "b", "k")).alias("p")).select("of", "p.a", "p.b", "p.k")
    counts = common.written(pair_counts(partial))
    totals = partial.join(counts.hint("merge"), ["a", "b"]).select("of", "a", "b", "total", "best")
    own = made.where("own").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return _summed(own, totals)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
