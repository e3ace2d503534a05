"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

A document's set are its distinct 4-word shingles (64-bit hashes). Documents link at a Jaccard
similarity of 80 per cent or more; each gets the smallest doc_id it can reach by links.

1. One pass over the texts gives each document the name of its set, the ``BANDS`` keys of its MinHash
   samples (``ROWS`` samples a key) and its odd sketch: each sample (position, value) flips one of
   ``BITS`` bits, so samples that two documents share cancel out in the XOR of their sketches, and the
   population count tells how many they do not share. Equal sets are one node from here on.
2. Nodes with an equal key are a bucket. Each bucket has one leader, drawn by hash, and only pairs of a
   leader and a member are made: as many as there are members, however large a family is. Leaders are drawn by
   ``DRAWS`` orders of the nodes, so the buckets that a family has in common have few leaders. Pairs of too
   different sizes, or whose sketches differ in more than ``FARTHEST`` bits, go; the others are compared
   by their full sets. The links found make components.
3. That leaves pairs in one bucket, in different components, of which neither is the leader. Buckets
   with one component are done. The others are cut into blocks: members of the bucket's
   largest component, and the rest; blocks meet in tasks of at most about two blocks, never two blocks
   of the largest component. There sketches are compared, and no pair leaves the task: only members
   with a pair that passes stay, get their full sets, and meet again in their blocks, where the sets
   decide. What leaves is at most one link for two components in a block.

A link at exactly 80 per cent shares no key with a chance of (1 - 0.8^ROWS)^BANDS, about 3e-7, and is
lost by its sketch with a chance of about 3e-7 (5 standard errors); one at 90 per cent, 4e-17. All else is exact.

Null and empty texts, and those of white space, have no shingles, link with nothing, and are their own
component. Rows with null ids are their own component, null, and kept. Rows that repeat an id and a text get
equal results; rows that repeat an id with other texts are nodes of their own with that id. Other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import Shingles, components

WORDS, SIMILARITY = 4, 80
ROWS, BANDS, BITS = 6, 50, 1024
SAMPLES = ROWS * BANDS
#: Members of a block, about.
BLOCK = 256
#: Orders by which leaders are drawn.
DRAWS = 4

_RNG = np.random.default_rng(17)
_FLIP, _ODD, _SEED = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64), _RNG.integers(0, 1 << 63, SAMPLES, np.uint64) * 2 + 1, _RNG.integers(0, 1 << 63, SAMPLES, np.uint64)


def farthest() -> int:
    """Bits in which the sketches of two documents of the least similarity differ, and five standard errors more."""
    s = SIMILARITY / 100
    apart = 2 * SAMPLES * (1 - s)
    p = (1 - np.exp(-2 * apart / BITS)) / 2
    slope = np.exp(-2 * apart / BITS)
    return int(BITS * p + 5 * np.sqrt(slope**2 * 4 * SAMPLES * s * (1 - s) + BITS * p * (1 - p)))


FARTHEST = farthest()


def samples(tokens: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: 32 bits of the least hash for each position."""
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(tokens), 512):
        hashed = (tokens[k : k + 512, None] ^ _FLIP) * _ODD
        np.minimum(out, hashed.min(0) >> np.uint64(32), out=out)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """Band keys (documents, BANDS) of samples (documents, SAMPLES)."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out ^ (sig[:, k::ROWS] + _SEED[k::ROWS])) * _ODD[0]
        out ^= out >> np.uint64(29)
    return out * _ODD[1]


def sketches(sig: np.ndarray) -> np.ndarray:
    """Odd sketches (documents, BITS / 8 bytes)."""
    at = (((sig ^ _SEED) * _ODD) >> np.uint64(20)) % np.uint64(BITS)
    row = np.repeat(np.arange(len(sig)), SAMPLES)
    odd = np.bincount(row * BITS + at.ravel().astype(np.int64), minlength=len(sig) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sig), BITS), axis=1)


def _signed(texts: DataFrame) -> DataFrame:
    """doc_id, n, c1, c2 (the set's name), bands, sketch; the last two null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(WORDS)
        for block in common.blocks(batches, "text", 1 << 20):
            sets = shingles(common.utf8(block.column(1)))
            names = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            halves = [np.array([(v >> s) & 0xFFFFFFFFFFFFFFFF for v in names], np.uint64).view(np.int64) for s in (0, 64)]
            sig = np.array([samples(x) for x in sets])
            bands, odd = keys(sig), sketches(sig)
            columns = [pa.array([v.tobytes() if len(x) else None for v, x in zip(values, sets)], pa.binary()) for values in (bands, odd)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, halves), *columns], names=["doc_id", "n", "c1", "c2", "bands", "sketch"])

    return texts.mapInArrow(work, "doc_id long, n long, c1 long, c2 long, bands binary, sketch binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(key, node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["key", "node"])

    return nodes.select("node", "bands").mapInArrow(work, "key long, node long")


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of whether sketches (rows of 64-bit words) differ in few enough bits."""
    apart = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return apart <= FARTHEST


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Matrix of whether sets of such sizes can link."""
    return (n[:, None] * 100 >= m[None, :] * SIMILARITY) & (m[None, :] * 100 >= n[:, None] * SIMILARITY)


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches let them link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
                few = np.bitwise_count(x ^ y).sum(1) <= FARTHEST
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(few))

    side = lambda c, s, n: nodes.select(F.col("node").alias(c), F.col("sketch").alias(s), F.col("n").alias(n)).hint("merge")
    both = pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
    fits = (F.col("na") * 100 >= F.col("nb") * SIMILARITY) & (F.col("nb") * 100 >= F.col("na") * SIMILARITY)
    return both.where(fits).select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of nodes (doc_id, c1, c2, node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(WORDS)
        for block in common.blocks(batches, "text", 1 << 20):
            sets = [x.tobytes() for x in shingles(common.utf8(block.column(1)))]
            names = [xxhash.xxh3_128_intdigest(x) for x in sets]
            halves = [np.array([(v >> s) & 0xFFFFFFFFFFFFFFFF for v in names], np.uint64).view(np.int64) for s in (0, 64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, halves), pa.array(sets, pa.binary())], names=["c1", "c2", "tokens"])

    wanted = texts.join(nodes.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    made = wanted.mapInArrow(work, "c1 long, c2 long, tokens binary")
    return made.join(nodes.select("c1", "c2", "node").hint("merge"), ["c1", "c2"]).dropDuplicates(["node"]).select("node", "tokens")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "x", 4 << 20):
            good = []
            for x, y in zip(block.column(2).to_pylist(), block.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= SIMILARITY * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(block.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], by: int, limit: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups (equal first ``by`` columns), with the groups' first rows."""
    kept: list[pa.RecordBatch] = []

    def firsts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in range(by):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= limit or sum(b.nbytes for b in kept) >= common.BLOCK_BYTES:
            whole = pa.Table.from_batches(kept).combine_chunks()
            at = firsts(whole)
            if len(at) > 1:
                yield whole.slice(0, at[-1]), at[:-1]
            kept = whole.slice(at[-1]).to_batches()
    if kept:
        whole = pa.Table.from_batches(kept).combine_chunks()
        yield whole, firsts(whole)


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, p, q, left, node, component): members of undecided buckets, in each pair of blocks that they meet in.

    ``rows`` has key, node, component. Blocks are numbered with the largest component's first; in (p, q)
    the left ones are of block p and the others of block q, and p = q is one block with itself, all left.
    """
    counted = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    largest = counted.groupBy("key").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = common.written(largest.select("key", F.col("most.component").alias("main"), blocks(F.col("most.k")).alias("p0"), blocks(F.col("all") - F.col("most.k")).alias("q0")))
    placed = rows.join(sizes.hint("merge"), "key")
    main, salt = F.col("component") == F.col("main"), F.xxhash64("node")
    own = F.when(main, F.pmod(salt, F.col("p0"))).otherwise(F.col("p0") + F.pmod(salt, F.col("q0"))).cast("int")
    last = F.col("p0") + F.col("q0") - 1
    others = F.sequence(F.col("p0"), last)
    as_left = F.when(main, F.transform(others, lambda q: F.struct(F.col("own").alias("p"), q.alias("q"), F.lit(True).alias("left")))).otherwise(
        F.transform(F.sequence(F.col("own"), last), lambda q: F.struct(F.col("own").alias("p"), q.alias("q"), F.lit(True).alias("left")))
    )
    as_right = F.when(main | (F.col("own") == 0), F.array().cast("array<struct<p:int,q:int,left:boolean>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda p: F.struct(p.alias("p"), F.col("own").alias("q"), F.lit(False).alias("left")))
    )
    cells = placed.withColumn("own", own).select("key", "node", "component", F.explode(F.concat(as_left, as_right)).alias("c"))
    return cells.select("key", "c.p", "c.q", "c.left", "node", "component")


def _compared(cells: DataFrame, extra: list[str], out: str, each) -> DataFrame:
    """``each`` over the groups (key, p, q) of cells, which have the columns of _blocks and ``extra``, sorted by left first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in _groups(batches, 3):
            yield from each(table, firsts)

    dealt = cells.select("key", "p", "q", "left", "node", "component", *extra).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(work, out)


def _sides(left: np.ndarray, a: int, b: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(a, b)
    return (rows, rows) if one else (rows[left[a:b]], rows[~left[a:b]])


def _open(table: pa.Table, a: int, b: int, views: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x and y of a group, and the matrix of pairs in different components whose sizes and sketches let them link."""
    one = views["p"][a] == views["q"][a]
    x, y = _sides(views["left"], a, b, one)
    ok = (views["component"][x][:, None] != views["component"][y][None, :]) & alike(views["n"][x], views["n"][y])
    if ok.any():
        ok &= near(views["sketch"][x], views["sketch"][y])
    return x, y, np.triu(ok, 1) if one else ok


def _views(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: table[c].to_numpy() for c in ("p", "q", "left", "node", "component", "n")}
    out["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return out


def _hopeful(table: pa.Table, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The members with a pair that passes."""
    views, keep = _views(table), np.zeros(table.num_rows, bool)
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), table.num_rows]):
        x, y, ok = _open(table, a, b, views)
        keep[x[ok.any(1)]] = True
        keep[y[ok.any(0)]] = True
    yield from table.select(["key", "p", "q", "left", "node", "component", "n", "sketch"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _linked(table: pa.Table, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b) by full sets, one at most for two components."""
    views = _views(table)
    tokens = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
    found_a, found_b = [], []
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), table.num_rows]):
        x, y, ok = _open(table, a, b, views)
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        for k in np.flatnonzero(ok.any(1)).tolist():
            others = y[ok[k]]
            size = np.array([len(tokens[j]) for j in others])
            flat, mine = np.concatenate([tokens[j] for j in others]), tokens[x[k]]
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            same = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            for j in others[100 * same >= SIMILARITY * (len(mine) + size - same)].tolist():
                s, t = top(int(views["component"][x[k]])), top(int(views["component"][j]))
                if s != t:
                    up[s] = t
                    found_a.append(int(views["node"][x[k]]))
                    found_b.append(int(views["node"][j]))
    yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def _rest(rows: DataFrame, nodes: DataFrame, connected: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside buckets between different components (step 3)."""
    held = connected.select(F.col("id").alias("node"), "component")
    marked = common.written(rows.join(held.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    cells = _blocks(marked).join(nodes.select("node", "n", "sketch").hint("merge"), "node")
    fields = "key long, p int, q int, left boolean, node long, component long, n long, sketch binary"
    hopeful = common.written(_compared(cells, ["n", "sketch"], fields, _hopeful))
    wanted = common.written(nodes.join(hopeful.select("node").distinct().hint("merge"), "node", "left_semi").select("doc_id", "c1", "c2", "node"))
    sets = common.written(_sets(texts, wanted), 500)
    links = common.written(_compared(hopeful.join(sets.hint("merge"), "node"), ["n", "sketch", "tokens"], "a long, b long", _linked), 500)
    for done in (marked, hopeful, wanted, sets):
        common.dropped(done)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = common.written(_signed(texts))
    usable = made.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = common.written(classes.withColumn("node", F.monotonically_increasing_id()))

    drawn = F.xxhash64(F.pmod("key", F.lit(DRAWS)), "node")
    leader = F.min(F.struct(drawn.alias("h"), "node"))["node"].alias("leader")
    buckets = common.written(_band_rows(nodes).groupBy("key").agg(F.count("*").alias("k"), leader).where("k > 1").select("key", "leader"))
    rows = common.written(_band_rows(nodes).join(buckets.hint("merge"), "key"))
    pairs = rows.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    close = common.written(screened(common.written(pairs), nodes))
    ends = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct()
    wanted = common.written(nodes.join(ends.hint("merge"), "node", "left_semi").select("doc_id", "c1", "c2", "node"))
    sets = common.written(_sets(texts, wanted), 500)
    links = common.written(verified(close, sets), 500)
    for done in (wanted, sets, close, buckets):
        common.dropped(done)

    connected = components(links)
    more = _rest(rows.select("key", "node"), nodes, connected, texts)
    if more.limit(1).count():
        connected = components(common.written(links.unionAll(more)))
    common.dropped(rows)

    part = nodes.join(connected.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("c1", "c2", "doc_id", F.coalesce("component", "node").alias("component"))
    part = common.written(part)
    smallest = part.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = common.written(part.join(smallest.hint("merge"), "component").select("c1", "c2", "component_id"))
    out = made.select("doc_id", "n", "c1", "c2").join(named.hint("merge"), ["c1", "c2"], "left")
    own = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[i : i + 3] END, ' ') AS t
  FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
