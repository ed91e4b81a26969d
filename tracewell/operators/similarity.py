"""Pairwise TF-IDF cosine of texts, the weights fitted on just the two texts of a pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a term that one of two texts holds: ln(3 / 2) + 1; a shared term weighs 1.
ONE_SIDED = math.log(1.5) + 1


def _cosine(shared: Column, shared_a: Column, shared_b: Column, all_a: Column, all_b: Column) -> Column:
    w = ONE_SIDED**2
    norm = lambda every, common: w * every - (w - 1) * common
    return F.coalesce(shared / F.nullif(F.sqrt(norm(all_a, shared_a) * norm(all_b, shared_b)), F.lit(0.0)), F.lit(0.0))


def term_counts(texts: DataFrame) -> DataFrame:
    """(id, term, n, norm) of (id, terms): counts, and the sum of squares of the text's counts."""
    c = texts.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    squares = c.groupBy("id").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    return c.join(squares, "id")


def _pair_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of pairs (a, b, hashed terms of a, hashed terms of b), all pairs of a batch at once."""
    w = ONE_SIDED**2
    for batch in batches:
        n = batch.num_rows
        sides = []
        for c in (2, 3):
            lists = batch.column(c)
            offsets = lists.offsets.to_numpy()
            sides.append((np.repeat(np.arange(n), np.diff(offsets)), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]))
        terms, local = np.unique(np.concatenate([sides[0][1], sides[1][1]]), return_inverse=True)
        cut, width = len(sides[0][1]), max(1, len(terms))
        (p, x), (q, y) = (np.unique(row * width + at, return_counts=True) for row, at in ((sides[0][0], local[:cut]), (sides[1][0], local[cut:])))
        x, y = x.astype(float), y.astype(float)
        _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
        both = p[i] // width
        s, sx, sy = (np.bincount(both, v, n) for v in (x[i] * y[j], x[i] * x[i], y[j] * y[j]))
        xx, yy = np.bincount(p // width, x * x, n), np.bincount(q // width, y * y, n)
        scale = np.sqrt((w * xx - (w - 1) * sx) * (w * yy - (w - 1) * sy))
        score = np.divide(s, scale, out=np.zeros(n), where=scale > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "score"])


def pair_cosine(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, score) of given pairs (a, b) of text ids (id, terms): for each pair its own two texts, no join by term.

    Texts without terms, and ids without a text, have score 0; a pair given several times comes out once. Only texts that a pair names are
    shuffled, as one 64-bit hash per term; the products are formed per batch of pairs. Cost is linear in the lengths of the pairs' texts.
    """
    left = pairs.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct()
    hashed = texts.select(F.col("id").cast("bigint").alias("id"), F.transform("terms", lambda t: F.xxhash64(t)).alias("h")).where(F.size("h") > 0)
    none = F.array().cast("array<bigint>")
    for side in ("a", "b"):
        left = left.join(hashed.select(F.col("id").alias(side), F.col("h").alias(f"h{side}")), side, "left")
    both = left.select("a", "b", F.coalesce("ha", none).alias("ha"), F.coalesce("hb", none).alias("hb"))
    return both.mapInArrow(_pair_scores, "a bigint, b bigint, score double")


def _best(found: list[tuple], k: int) -> tuple:
    """The ``k`` best rows of each query among (query, node, score) arrays, ties by node descending."""
    q, node, score = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((-node, -score, q))
    q, node, score = q[order], node[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return q[place < k], node[place < k], score[place < k]


#: Queries that are searched together, texts that pass by them at once, and terms of these queries, the most frequent ones, that are multiplied as
#: matrices; the others are added up by posting.
TILE, GROUP, HEAVY = 2048, 128, 192


def _index(rows: list) -> tuple:
    """Of query rows (id, at, h), in order of time: ids, times, distinct hashes, where the postings of each begin, their queries and counts, norms."""
    pairs = [np.unique(np.array(r.h, dtype=np.int64), return_counts=True) for r in rows]
    term = np.concatenate([t for t, _ in pairs])
    order = np.argsort(term, kind="stable")
    hashes, first = np.unique(term[order], return_index=True)
    owner = np.repeat(np.arange(len(rows)), [len(t) for t, _ in pairs])[order]
    count = np.concatenate([n for _, n in pairs]).astype(float)[order]
    norm = np.array([float((n * n).sum()) for _, n in pairs])
    return np.array([r.id for r in rows]), np.array([r.at for r in rows]), hashes, np.append(first, len(term)), owner, count, norm


def _counted(batch: pa.RecordBatch) -> tuple:
    """Of a batch (id, at, hashed terms): ids and times, in order of time, the distinct hashes, and text, term and count of each text's terms, norms."""
    batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
    lists = batch.column(2)
    local, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    code, n = np.unique(text * len(local) + at, return_counts=True)
    n, text = n.astype(float), code // len(local)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), local, text, code % len(local), n, np.bincount(text, n * n, batch.num_rows)


class _Tile:
    """The ``k`` best texts so far of each query of an index."""

    def __init__(self, index: tuple, k: int):
        self.ids, self.ats, self.hashes, self.start, self.owner, self.count, self.norm = index
        self.k, self.found, self.held, self.kept = k, [], 0, 0
        size = np.diff(self.start)
        heavy = np.sort(np.argsort(-size, kind="stable")[:HEAVY])
        self.slot = np.full(len(size) + 1, -1)
        self.slot[heavy] = np.arange(len(heavy))
        self.size, self.start = np.append(size, 0), np.append(self.start, self.start[-1])  # the last place is that of terms without postings
        posts = self.slot[np.repeat(np.arange(len(size)), size)]
        own = posts >= 0
        self.x = np.zeros((len(self.ids), len(heavy)), np.float32)
        self.x[self.owner[own], posts[own]] = self.count[own]
        self.xx, self.has = self.x * self.x, (self.x > 0).astype(np.float32)
        self.least = np.zeros(len(self.ids))

    def cut(self) -> None:
        """Leaves the best, and sets for each query the score that a text needs to be among them."""
        q, node, score = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        order = np.argsort(q - (score + 1) / 4)
        q, node, score = q[order], node[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.ids) + 1))
        full = np.diff(first) >= self.k
        self.least[full] = score[first[:-1][full] + self.k - 1]
        keep = score >= self.least[q] - 1e-9
        q, node, score = q[keep], node[keep], score[keep]
        if len(q) > 2 * self.k * len(self.ids):  # many equals
            q, node, score = _best([(q, node, score)], self.k)
        self.found, self.held, self.kept = [(q, node, score)], len(q), len(q)

    def best(self) -> tuple:
        q, node, score = _best(self.found, self.k)
        return self.ids[q], node, score

    def search(self, counted: tuple) -> None:
        node, when, local, text, term, n, norms = counted
        w, top = ONE_SIDED**2, len(self.hashes)
        at = np.searchsorted(self.hashes, local)
        at[at == top] = 0
        place = np.where(self.hashes[at] == local, at, top)[term]
        kind = np.float32 if max(self.norm.max(), norms.max()) < 2**24 else np.float64  # sums of whole numbers, exact up to here
        x, xx, has = (m.astype(kind, copy=False) for m in (self.x, self.xx, self.has))
        if kind is np.float64:
            xx = x * x
        room = np.empty((5, GROUP * len(self.ids)), kind)
        slot = self.slot[place]
        starts = np.searchsorted(text, np.arange(0, len(node) + GROUP, GROUP))
        for g, a, b in zip(range(0, len(node), GROUP), starts, starts[1:]):
            low = int(np.searchsorted(self.ats, when[g], "right"))  # the queries before this are not later than any text from here on
            if low == len(self.ids):
                break
            m, width = min(GROUP, len(node) - g), len(self.ids) - low
            d, c, p, own = text[a:b] - g, n[a:b], place[a:b], slot[a:b]
            s, sx, sy, left, right = (room[i, : m * width].reshape(m, width) for i in range(5))
            y = np.zeros((m, x.shape[1]), kind)
            y[d[own >= 0], own[own >= 0]] = c[own >= 0]
            for mine, theirs, sums in ((y, x, s), ((y > 0).astype(kind), xx, sx), (y * y, has, sy)):
                np.matmul(mine, theirs[low:].T, out=sums)
            rest = (own < 0) & (self.size[p] > 0)
            d, c, p = d[rest], c[rest], p[rest]
            size = self.size[p]
            post = np.repeat(self.start[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            q, d, c = self.owner[post], np.repeat(d, size), np.repeat(c, size)
            late = q >= low
            cell, u, v = (d * width + q - low)[late], self.count[post[late]].astype(kind), c[late].astype(kind)
            for sums, value in ((s, u * v), (sx, u * u), (sy, v * v)):
                np.add.at(sums.reshape(-1), cell, value)
            own, other = self.norm[low:], norms[g : g + m]
            limit = np.square(np.maximum(self.least[low:] * (1 - 1e-4) - 1e-9, 0)).astype(kind)
            np.multiply(sx, kind(1 - w), out=left)
            left += (w * own).astype(kind)
            np.multiply(sy, kind(1 - w), out=right)
            right += (w * other).astype(kind)[:, None]
            left *= right
            left *= limit
            hit = np.flatnonzero(np.multiply(s, s, out=right) >= left)  # a little more than can be among the best
            d, q = np.divmod(hit, width)
            s, sx, sy = (sums.reshape(-1)[hit].astype(float) for sums in (s, sx, sy))
            score = np.round(s / np.sqrt((w * own[q] - (w - 1) * sx) * (w * other[d] - (w - 1) * sy)), 9)
            q, d = q + low, d + g
            good = (s > 0) & (when[d] < self.ats[q]) & (score >= self.least[q])
            self.found.append((q[good], node[d[good]], score[good]))
            self.held += len(self.found[-1][0])
            if self.held > self.kept + max(100_000, self.k * len(self.ids)):
                self.cut()


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[_Tile] = []
        for batch in batches:
            tiles = tiles or [_Tile(index, k) for index in block.value]
            counted = _counted(batch)
            for tile in tiles:
                tile.search(counted)
        for tile in tiles:
            if tile.held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tile.best()], names=["query", "node", "score"])

    return run


#: Terms of all queries of a block together; a block's index takes about 24 bytes for each.
BLOCK_TERMS = 4_000_000


def earlier_similar(queries: DataFrame, texts: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query, node, score): the ``k`` earlier texts most like each query text, ties by id descending.

    ``queries`` and ``texts``: (id, at, terms), stored, with bigint ids and times; earlier is strictly less in ``at``. Only texts that share a
    term with the query are found. Rows with a null id or time, or without terms, count nowhere.

    ``queries`` is a stated set of queries, searched in blocks of about ``block_terms`` terms: a block's term counts are broadcast as an
    inverted index by ``TILE`` queries, whose bytes that number bounds, and each task passes its texts through it once, keeping the ``k`` best
    per query. So nothing but the best is shuffled, and no common term makes a hot key. The frequent terms of a tile are multiplied as dense
    matrices, the others posting by posting; both give whole numbers, so scores are exact. Queries and the texts of a batch stand in order of
    time, so a text meets the later queries only. Only a pair that may beat the ``k`` best so far is scored in full.
    """
    spark = texts.sparkSession
    hashed = lambda df: df.select("id", "at", F.transform("terms", lambda t: F.xxhash64(t)).alias("h")).dropna(subset=["id", "at"]).where(F.size("h") > 0)
    each, q = hashed(texts), hashed(queries)
    blocks = max(1, -(-(q.agg(F.sum(F.size("h"))).first()[0] or 0) // block_terms))
    out = None
    for b in range(blocks):
        rows = sorted(q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect(), key=lambda r: r.at)  # about block_terms terms
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([_index(rows[i : i + TILE]) for i in range(0, len(rows), TILE)])
        part = each.mapInArrow(_search(shared, k), "query bigint, node bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query bigint, node bigint, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("node").desc())
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def nearest(queries: DataFrame, rows: DataFrame, k: int, block_queries: int = 50_000) -> DataFrame:
    """(query, node, score): the ``k`` other rows (id, vector) with the greatest cosine to each query row, exact, ties by id descending.

    The cosine is rounded to nine decimals; vectors have one length, zero vectors have cosine 0, and rows with a null id or vector count nowhere.
    The queries are a stated set, searched in blocks: ``block_queries`` of their vectors are broadcast, every task passes its rows by them.
    """
    spark = rows.sparkSession
    wide = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("v")).dropna()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    q, each = wide(queries), wide(rows)
    blocks = max(1, -(-q.count() // block_queries))
    out = None
    for b in range(blocks):
        found = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not found:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.id for r in found]), unit(np.array([r.v for r in found]))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            held: list[tuple] = []
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    part = batch.slice(low, 500)
                    node = part.column(0).to_numpy()
                    score = np.round(unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)) @ vectors.T, 9)
                    for at in range(0, len(ids), 1000):
                        s = score[:, at : at + 1000]
                        asked = np.broadcast_to(ids[at : at + 1000], s.shape)
                        nodes = np.broadcast_to(node[:, None], s.shape)
                        other = asked != nodes
                        held.append((asked[other], nodes[other], s[other]))
                    held = [_best(held, k)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["query", "node", "score"])

        part = each.mapInArrow(run, "query bigint, node bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query bigint, node bigint, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("node").desc())
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
