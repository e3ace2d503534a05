"""Exact Jaccard join of documents over word shingles, by a matrix of tokens and groups.

A document's tokens are its distinct 5-word shingles (64-bit hashes). Two documents link when
their sets have a Jaccard similarity of ``SIMILARITY`` per cent or more; the result names, for
each document, the smallest id it can reach by links. No link between different sets is
lost:

1. Equal sets are one class, represented by its smallest id.
2. Tokens are put in one order for all documents, and only prefixes are compared. Two linked
   documents share at least ``spare`` tokens of the prefixes that are that much longer than
   the shortest sufficient ones, so documents with fewer shared tokens drop out. The first
   order is by hash; tokens that it shows to be common then go last, and so do those that the prefixes
   of this order show, for some rounds: what stood beyond the first prefixes is only seen then. So boilerplate
   leaves the prefixes, and what is left is pruned again.
3. Similar documents are partitioned into groups. Each token's most central document, whose tokens
   most others share, is a hub, and so is the most central one of each class of sizes, for documents of
   sizes too far from the first one's; a document belongs to the largest group among the hubs of its tokens
   that are half alike, or to the nearest hub's. Its overlaps with the hubs are counted, and those that link are linked.
4. The matrix holds each group's token union, one row (token, group). Every document is a query:
   joined with the matrix by its prefix tokens, it keeps the groups whose union holds enough of
   them. Copies lie in one group whether they link or not, so a family costs one row a
   token, whatever its size. Only qualifying groups are opened: the query becomes their guest.
5. In a group, a document stands for its difference (tokens that it adds or lacks) from the group's centre, the tokens
   that most of its documents have. Two documents differ by what their differences don't share. So if the sizes of the
   differences alone prove a link, both link to the document nearest to the centre; otherwise they
   link only if the differences share enough tokens. Prefixes of the differences,
   with added tokens first, and the positions of shared ones leave few pairs, which are verified whole.
6. Links make components by contraction.

The common tokens are sent to the workers as one sorted array a round of at most ``COMMON`` hashes: the
most frequent ones, whatever the corpus. Which they are changes only the amount of work.

Null and empty texts have no tokens, link with nothing, and are their own component. Rows
repeating an id and a text get equal results; where an id has several texts each of them links for
itself, and a component's name is the smallest id of its rows. Rows with null ids are their own component,
null. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, 80
#: Documents from which on a token is common; bound of the common tokens.
OFTEN, COMMON = 20, 500_000
#: Orders after the second one, at most.
ROUNDS = 3
#: Similarity to a hub from which on its size decides.
NEAR = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]
_BASE, _MIX, _STEP = 0xB492B66FBE98F273, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct shingle hashes of each text."""

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        if len(self.up) <= len(data):
            n = len(data) + 1
            self.up, self.down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        edge = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(starts, offsets)
        out = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            n = min(self.words, b - a)
            if not n:
                out.append(np.empty(0, np.uint64))
                continue
            x = np.full(b - a - n + 1, n, np.uint64)
            for k in range(n):
                x = (x + h[a + k : b - n + 1 + k]) * _STEP
                x ^= x >> np.uint64(32)
            out.append(np.unique(x * _MIX))
        return out


def least_overlap(n):
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-SIMILARITY * n // 100)


def spare(n):
    return 1 + n // 20


def prefix(n: int, extra: int) -> int:
    """Tokens among which linked sets share at least ``extra``."""
    return min(n, n - least_overlap(n) + extra)


def _needed(n: Column) -> Column:
    """Shared tokens that a document with a partner has in the longer prefix: by its smallest partner."""
    return 1 + F.floor(F.ceil(n * SIMILARITY / 100) / 20)


def _tokens(docs: DataFrame) -> DataFrame:
    """First order: (token, doc_id) of the longer prefixes by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for block in common.blocks(batches, "text", 1 << 20):
            sets = [x[: prefix(len(x), spare(len(x)))] for x in shingles(common.utf8(block.column(1)))]
            sizes = np.array([len(x) for x in sets])
            ids = block.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), ids], names=["token", "doc_id"])

    return docs.mapInArrow(work, "token long, doc_id long")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, n, and a 128-bit name of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for block in common.blocks(batches, "text", 1 << 20):
            sets = shingles(common.utf8(block.column(1)))
            names = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            halves = [np.array([(v >> s) & 0xFFFFFFFFFFFFFFFF for v in names], np.uint64).view(np.int64) for s in (0, 64)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, halves)], names=["doc_id", "n", "c1", "c2"])

    return docs.mapInArrow(work, "doc_id long, n long, c1 long, c2 long")


def _sets(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """Second order: doc_id, n, tokens (hashes as bytes, common ones last)."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingles(), shared.value
        for block in common.blocks(batches, "text", 1 << 20):
            out, sizes = [], []
            for x in shingles(common.utf8(block.column(1))):
                common_ones = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x if len(last) else np.zeros(len(x), bool)
                out.append(np.concatenate([x[~common_ones], x[common_ones]]).tobytes())
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "tokens"])

    return docs.mapInArrow(work, "doc_id long, n long, tokens binary")


def _prefixes(sets: DataFrame, later: np.ndarray) -> DataFrame:
    """(token, doc_id, n): longer prefixes in the order of the sets, but with the tokens ``later`` (sorted) behind the others."""
    shared = sets.sparkSession.sparkContext.broadcast(later)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for block in common.blocks(batches, "tokens", 1 << 20):
            ns, parts = block.column(1).to_numpy(), []
            for t, n in zip(block.column(2).to_pylist(), ns.tolist()):
                x = np.frombuffer(t, np.uint64)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                    x = np.concatenate([x[~late], x[late]])
                parts.append(x[: prefix(n, spare(n))].view(np.int64))
            row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), block.column(0).take(pa.array(row)), pa.array(ns[row])], names=["token", "doc_id", "n"])

    return sets.mapInArrow(work, "token long, doc_id long, n long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "x", 4 << 20):
            good = []
            for x, y in zip(block.column(2).to_pylist(), block.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= SIMILARITY * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(block.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = one.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable by links (a, b), for all ids that have one.

    Each round points every id at its smallest neighbour (and on to that one's), contracts
    the links to what is pointed at, and drops those inside a group, so links soon vanish.
    """
    there = links.where("a <> b").select("a", "b")
    edges = common.written(there.unionAll(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        parent = common.written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).withColumnRenamed("a", "v"))
        up = parent.select(F.col("v").alias("at"), F.col("p").alias("further"))
        maps.append(common.written(parent.join(up, parent.p == up["at"]).select("v", F.col("further").alias("p"))))
        common.dropped(parent)
        ends = [maps[-1].select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        new = common.written(edges.join(ends[0], "a").join(ends[1], "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        common.dropped(edges)
        edges = new
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].select(F.col("v").alias("id"), F.col("p").alias("component"))
    for m in maps[1:]:
        up = m.select(F.col("v").alias("at"), F.col("p").alias("further"))
        out = out.join(up, out.component == up["at"], "left").select("id", F.coalesce("further", "component").alias("component"))
    return common.written(out)


def _hubs(rows: DataFrame) -> DataFrame:
    """(doc_id, hub): for each document, the most central ones of those with a token of it; where that one's size is too far from its own, the one of its class of sizes."""
    width = rows.groupBy("token").agg(F.count("*").alias("k"))
    score = rows.join(common.written(width).hint("merge"), "token").groupBy("doc_id").agg((F.sum("k") / F.first("n")).alias("score"))
    sizes = F.floor(F.log("n") / F.log(F.lit(10 / 6))).alias("sizes")
    scored = common.written(rows.join(score, "doc_id").select("token", "doc_id", "n", "score", sizes))
    own = common.written(scored.groupBy("token", "sizes").agg(F.max(F.struct("score", "doc_id", "n")).alias("own")))
    best = common.written(own.join(own.groupBy("token").agg(F.max("own").alias("best")).hint("merge"), "token"))
    near = (F.col("n") * 10 >= F.col("best.n") * 6) & (F.col("best.n") * 10 >= F.col("n") * 6)
    pairs = scored.join(best.hint("merge"), ["token", "sizes"]).select("doc_id", F.when(near, F.col("best.doc_id")).otherwise(F.col("own.doc_id")).alias("hub"))
    out = common.written(pairs.where("doc_id <> hub").distinct())
    for done in (scored, own, best):
        common.dropped(done)
    return out


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, hub, alike (Jaccard similarity), link (whether it suffices)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "x", 4 << 20):
            same, union = [], []
            for x, y in zip(block.column(2).to_pylist(), block.column(3).to_pylist()):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                same.append(int(np.count_nonzero(both[1:] == both[:-1])))
                union.append(len(both) - same[-1])
            same, union = np.array(same), np.array(union)
            yield pa.RecordBatch.from_arrays([*block.columns[:2], pa.array(same / union), pa.array(100 * same >= SIMILARITY * union)], names=["doc_id", "hub", "alike", "link"])

    one = pairs.join(sets.select("doc_id", F.col("tokens").alias("x")).hint("merge"), "doc_id")
    both = one.join(sets.select(F.col("doc_id").alias("hub"), F.col("tokens").alias("y")).hint("merge"), "hub")
    return both.select("doc_id", "hub", "x", "y").mapInArrow(work, "doc_id long, hub long, alike double, link boolean")


def _centres(homes: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, centre: the tokens that more than half of a group's documents have, sorted, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "tokens", 1 << 20):
            parts = [np.frombuffer(t, np.int64) for t in block.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            yield pa.RecordBatch.from_arrays([block.column(0).take(row), block.column(1).take(row), pa.array(np.concatenate(parts))], names=["hub", "half", "token"])

    half = homes.groupBy("hub").agg((F.count("*") / 2).cast("long").alias("half"))
    grouped = homes.select("doc_id", "hub").join(half.hint("merge"), "hub").join(sets.select("doc_id", "tokens").hint("merge"), "doc_id")
    counted = grouped.select("hub", "half", "tokens").mapInArrow(work, "hub long, half long, token long").groupBy("hub", "token", "half").agg(F.count("*").alias("k"))
    held = counted.where("k > half").groupBy("hub").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return held.select("hub", "tokens")


def _differences(roles: DataFrame, sets: DataFrame, centres: DataFrame) -> DataFrame:
    """doc_id, hub, guest, n, size (of the difference from the group's centre), and the prefix of the difference."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "tokens", 4 << 20):
            sizes, parts = [], []
            for x, y in zip(block.column(4).to_pylist(), block.column(5)):
                x, y = np.frombuffer(x, np.int64), y.values.to_numpy() if y.is_valid else np.empty(0, np.int64)
                # Added tokens, then lacking ones, each in the order of the sets: one order for the whole group.
                apart = np.concatenate([x[~np.isin(x, y)], y[~np.isin(y, x)]])
                sizes.append(len(apart))
                parts.append(apart[: _most_apart(len(x)) + 1].tobytes())
            yield pa.RecordBatch.from_arrays([*block.columns[:4], pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "hub", "guest", "n", "size", "apart"])

    both = roles.join(sets.hint("merge"), "doc_id").join(centres.select("hub", F.col("tokens").alias("centre")).hint("merge"), "hub", "left")
    return both.select("doc_id", "hub", "guest", "n", "tokens", "centre").mapInArrow(work, "doc_id long, hub long, guest boolean, n long, size long, apart binary")


def _most_apart(n: int) -> int:
    """Tokens by which a set of n differs from one it links to, at most."""
    return (n + n * 100 // SIMILARITY) * (100 - SIMILARITY) // (100 + SIMILARITY)


def guests(rows: DataFrame, homes: DataFrame) -> DataFrame:
    """(doc_id, hub): the groups, behind the document's own by id, that may hold a partner of it, by the bound of the token-group matrix."""
    cells = rows.select("token", "doc_id").join(homes.select("doc_id", "n", F.col("hub").alias("home")).hint("merge"), "doc_id")
    several = common.written(cells.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("token"))
    cells = common.written(cells.join(several.hint("merge"), "token"))
    matrix = common.written(cells.groupBy("token", F.col("home").alias("hub")).agg(F.min("n").alias("low"), F.max("n").alias("high")))
    fits = (F.col("home") < F.col("hub")) & (F.col("high") * 100 >= F.col("n") * SIMILARITY) & (F.col("n") * 100 >= F.col("low") * SIMILARITY)
    shared = cells.join(matrix.hint("merge"), "token").where(fits).groupBy("doc_id", "n", "hub").agg(F.count("*").alias("shared"))
    out = common.written(shared.where(F.col("shared") >= _needed(F.col("n"))).select("doc_id", "hub"))
    for done in (several, cells, matrix):
        common.dropped(done)
    return out


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a group, in different components, whose differences from the hub may share enough.

    ``members`` has doc_id, hub, guest, n, size (tokens of the difference), apart, component.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "apart", 1 << 20):
            parts = [np.frombuffer(x, np.int64) for x in block.column(0).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            at = np.concatenate([np.arange(len(x)) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(at), *(c.take(row) for c in block.columns[1:])], names=["token", "at", *names])

    names = ["doc_id", "hub", "guest", "n", "size", "component"]
    rows = members.select("apart", *names).mapInArrow(work, "token long, at long, doc_id long, hub long, guest boolean, n long, size long, component long")
    several = rows.groupBy("hub", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub", "token")
    rows = common.written(rows.join(common.written(several).hint("merge"), ["hub", "token"]))
    a, b = (rows.select("hub", "token", *(F.col(c).alias(c + k) for c in ("at", "doc_id", "guest", "n", "size", "component"))) for k in "12")
    low, high = 100 - SIMILARITY, 100 + SIMILARITY
    rest = F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))  # shared tokens from this one on, at most
    enough = rest * 2 * high >= (F.col("size1") + F.col("size2")) * high - (F.col("n1") + F.col("n2")) * low
    fits = (F.col("n1") * 100 >= F.col("n2") * SIMILARITY) & (F.col("n2") * 100 >= F.col("n1") * SIMILARITY)
    apart = (F.col("doc_id1") < F.col("doc_id2")) & (F.col("component1") != F.col("component2")) & ~(F.col("guest1") & F.col("guest2"))
    return a.join(b.hint("merge"), ["hub", "token"]).where(apart & fits & enough).select(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b")).distinct()


def linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all links."""
    near = common.written(_overlaps(_hubs(rows), sets))
    # Few large groups: the hub that most documents have, of those that are half alike; else the nearest.
    asking = near.where(F.col("alike") >= NEAR).groupBy("hub").agg(F.count("*").alias("asking"))
    first = F.max(F.struct(F.when(F.col("alike") >= NEAR, F.col("asking")).alias("asking"), "alike", "hub"))["hub"]
    best = common.written(near.join(asking.hint("merge"), "hub", "left").groupBy("doc_id").agg(first.alias("hub")))
    homes = common.written(sets.select("doc_id", "n").join(best.hint("merge"), "doc_id", "left").select("doc_id", "n", F.coalesce("hub", "doc_id").alias("hub")))
    for _ in range(2):  # a hub takes its followers along when it follows another one
        up = homes.select(F.col("doc_id").alias("hub"), F.col("hub").alias("further"))
        homes = common.written(homes.join(up.hint("merge"), "hub").select("doc_id", "n", F.col("further").alias("hub")))
    asked = guests(rows, homes)
    # Groups of one that nobody asks have no pairs.
    used = homes.groupBy("hub").agg(F.count("*").alias("k")).where("k > 1").select("hub").unionAll(asked.select("hub")).distinct()
    grouped = common.written(homes.join(used.hint("merge"), "hub").select("doc_id", "hub"))
    centres = common.written(_centres(grouped, sets), 500)
    roles = grouped.withColumn("guest", F.lit(False)).unionAll(asked.withColumn("guest", F.lit(True)))
    members = common.written(_differences(roles, sets, centres), 500)
    # Two documents link for sure if their slacks add up to 0 or more; then each does so with the one of the most slack.
    slack = F.col("n") * (100 - SIMILARITY) - F.col("size") * (100 + SIMILARITY)
    most = members.groupBy("hub").agg(F.max(F.struct(slack.alias("slack"), "doc_id")).alias("most"))
    sure = members.join(most.hint("merge"), "hub").where((slack + F.col("most.slack") >= 0) & (F.col("doc_id") != F.col("most.doc_id")))
    links = near.where("link").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).unionAll(sure.select(F.col("doc_id").alias("a"), F.col("most.doc_id").alias("b")))
    links = common.written(links)
    connected = components(links).withColumnRenamed("id", "doc_id")
    members = members.join(connected.hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    pairs = common.written(_candidates(common.written(members)))
    return common.written(links.unionAll(verified(pairs, sets)))


def _common_tokens(shared: DataFrame) -> np.ndarray:
    """The most frequent shared tokens, at most COMMON of them."""
    at = OFTEN
    while shared.where(F.col("k") > at).count() > COMMON:
        at *= 2
    got = shared.where(F.col("k") > at).select("token").toArrow()
    return np.sort(got.column("token").to_numpy().view(np.uint64))


def _pruned(rows: DataFrame) -> DataFrame:
    """Rows whose token others share, of documents that have enough of them."""
    shared = common.written(rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"))
    kept = common.written(rows.join(shared, "token"))
    alive = common.written(kept.groupBy("doc_id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= _needed(F.col("n"))).select("doc_id"))
    out = common.written(kept.join(alive, "doc_id"))
    for done in (shared, kept, alive):
        common.dropped(done)
    return out


def _ordered(sets: DataFrame, often: np.ndarray) -> DataFrame:
    """Prefixes in an order whose common tokens, as far as the rounds see them, stand last."""
    later = np.empty(0, np.uint64)
    for _ in range(ROUNDS):
        shared = common.written(_prefixes(sets, later).groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > OFTEN))
        fresh = np.setdiff1d(_common_tokens(shared), np.union1d(often, later))
        common.dropped(shared)
        if not len(fresh):
            break
        later = np.union1d(later, fresh)
    return _prefixes(sets, later)


def _by_row(texts: DataFrame) -> DataFrame:
    """``joined`` of rows under numbers of their own, named by the smallest id afterwards."""
    rows = common.written(texts.withColumn("row", F.monotonically_increasing_id()))
    there = rows.where("doc_id is not null")
    found = common.written(joined(there.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row"))
    named = found.join(there.select("row", "doc_id"), "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = named.join(least.hint("merge"), "component_id").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    nobody = _classes(rows.where("doc_id is null").select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nobody)


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    members = common.written(_classes(texts))
    usable = members.where("n > 0 and doc_id is not null")
    per = usable.groupBy("doc_id").agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.count("*").alias("rows"))
    ids = per.agg(F.max(F.col("low") != F.col("high")).alias("several"), F.max("rows").alias("rows")).first()
    if ids["several"]:
        return _by_row(texts)
    reps = common.written(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))

    rows = _tokens(texts.where("doc_id is not null"))
    shared = common.written(rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    counts = rows.join(shared.select("token"), "token").groupBy("doc_id").agg(F.count("*").alias("k"))
    alive = common.written(counts.join(reps.select(F.col("rep").alias("doc_id"), "n"), "doc_id").where(F.col("k") >= _needed(F.col("n"))).select("doc_id"))
    often = _common_tokens(shared)
    common.dropped(shared)
    sets = common.written(_sets(texts.join(alive.hint("merge"), "doc_id", "left_semi"), often), 500)
    if (ids["rows"] or 0) > 1:  # rows that repeat an id and its text
        sets = common.written(sets.dropDuplicates(["doc_id"]), 500)

    links = linked(_pruned(_pruned(_ordered(sets, often))), sets)
    held = components(links)
    class_of = common.written(reps.join(held, reps.rep == held.id, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")))
    out = members.join(class_of, ["c1", "c2"], "left")
    own = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group, and those without an id or tokens, with all their columns."""
    found = joined(docs)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(common.written(others).hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END, ' ') AS t
  FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY 1, 2
"""
