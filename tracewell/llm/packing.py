"""Filling fixed-capacity containers with texts, related ones together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import range_sums
from ..session import materialize

CAPACITY = 2048
#: Items that share one inverted index. Packing is within a shard, whatever the number of shards.
SHARD_ITEMS = 2000
_K1, _B = 1.2, 0.75
#: Places of a content vector, items that the topics are fitted on, most topics, and most parts of all topics together.
DIMENSIONS, SAMPLE_ITEMS, TOPICS, PARTS = 256, 5_000, 64, 1 << 20
#: Items smaller than this share of the free space wait for closing gaps.
_SMALL = 16


def _weights(terms: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, term, BM25 weight) of the distinct terms of all items, in order of items, then terms."""
    size = np.array([len(x) for x in terms], dtype=np.int64)
    if not size.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    code = np.sort(np.repeat(np.arange(len(terms)), size) * len(idf) + np.concatenate(terms))
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(first, len(code)))
    item, t = code[first] // len(idf), code[first] % len(idf)
    return item, t, idf[t] * n * (_K1 + 1) / (n + _K1 * (1 - _B + _B * size[item] / max(mean, 1e-9)))


def vectors(terms: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Content vectors of unit length (BM25 weights, terms hashed to DIMENSIONS places with a sign), and each item's weightiest term (0 without terms)."""
    out, top = np.zeros((len(terms), DIMENSIONS), dtype=np.float32), np.zeros(len(terms), dtype=np.int64)
    h = (np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = np.where((h >> np.uint64(12)) & np.uint64(1), 1.0, -1.0)
    at = (h % np.uint64(DIMENSIONS)).astype(np.int64)
    for low in range(0, len(terms), 500):
        part = terms[low : low + 500]
        item, t, w = _weights(part, idf, mean)
        if not len(item):
            continue
        out[low : low + len(part)] = np.bincount(item * DIMENSIONS + at[t], w * sign[t], len(part) * DIMENSIONS).reshape(-1, DIMENSIONS)
        own = np.flatnonzero(np.diff(item, prepend=-1))  # where an item's terms begin
        best = np.maximum.reduceat(w, own)
        places = np.flatnonzero(w == np.repeat(best, np.diff(np.append(own, len(w)))))
        whose, place = np.unique(item[places], return_index=True)
        top[low + whose] = t[places[place]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), top


def topics(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of unit vectors by spherical k-means, in an order in which neighbours are alike."""
    if not len(sample):
        return np.zeros((1, DIMENSIONS), dtype=np.float32)
    centres = sample[np.random.default_rng(1).choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, (sample @ centres.T).argmax(1), sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    order, left = [0], list(range(1, len(centres)))
    while left:
        order.append(left.pop(int(np.argmax(centres[left] @ centres[order[-1]]))))
    return centres[order]


class _Index:
    """BM25 inverted index of the items of one shard."""

    def __init__(self, terms: list[np.ndarray], idf: np.ndarray, mean: float):
        item, t, weight = _weights(terms, idf, mean)
        self.query = np.split(t, np.searchsorted(item, np.arange(1, len(terms))))
        order = np.argsort(t, kind="stable")
        self.n, self.doc, self.weight = len(terms), item[order], weight[order]
        self.start = np.searchsorted(t[order], np.arange(len(idf) + 1))

    def scores(self, item: int) -> np.ndarray:
        t = self.query[item]
        low, size = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(sizes: np.ndarray, terms: list[np.ndarray], idf: np.ndarray, mean: float, capacity: int) -> list[list[int]]:
    """Containers (lists of items) of one shard.

    The largest unused item is the seed; its nearest unused neighbours by BM25 fill the window greedily, and what is
    left is closed with the largest items that fit. Items without tokens go into the first container.
    """
    empty = np.flatnonzero(sizes == 0).tolist()
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return [empty] if empty else []
    index, unused, out = _Index(terms, idf, mean), sizes > 0, []
    for seed in order:
        if not unused[seed]:
            continue
        unused[seed] = False
        members, free = [int(seed)], capacity - int(sizes[seed])
        least = sizes[unused].min() if unused.any() else capacity + 1
        if free >= least:
            near = np.flatnonzero(unused & (sizes <= free))
            near = near[np.argsort(-index.scores(seed)[near], kind="stable")]
            s, at = sizes[near], 0
            while at < len(near):
                ok = (s[at:] <= free) & (s[at:] >= free // _SMALL)
                step = int(ok.argmax())
                if not ok[step]:
                    break
                at += step + 1
                i = near[at - 1]
                unused[i] = False
                members.append(int(i))
                free -= int(sizes[i])
                if free < least:
                    break
            while free >= least:
                fits = near[unused[near] & (sizes[near] <= free)]
                if not len(fits):
                    break
                i = fits[np.argmax(sizes[fits])]  # the nearest of the largest
                unused[i] = False
                members.append(int(i))
                free -= int(sizes[i])
        out.append(members)
    out[0] += empty
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sharded(items: DataFrame, n: int, idf, mean: float, shard_items: int) -> DataFrame:
    """``items`` (key, piece, ids, ...) with ``_shard``: shards of about ``shard_items`` items of like content.

    Topics are fitted on the content vectors of about SAMPLE_ITEMS items chosen by a hash; every item goes to its nearest topic and, within
    it, to a part named by its weightiest term. Topics and parts stand in a fixed order, and an item's place is the number of items in the
    parts before its own plus a place by hash within it; so shards are even, and a part with many items (copies, say) is cut
    into several. The parts are at most PARTS, whatever the number of items, so their table can be broadcast.
    """
    shards = max(1, -(-n // shard_items))
    if shards == 1:
        return items.withColumn("_shard", F.lit(0).cast("bigint"))
    spark = items.sparkSession
    every = max(1, n // SAMPLE_ITEMS)
    place = F.xxhash64("key", "piece")

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, _ = vectors(_lists(batch.column(0)), idf.value, mean)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float32()))], names=["v"])

    chosen = items.where((F.pmod(place, F.lit(every)) == 0) & (F.size("ids") > 0)).select("ids").mapInArrow(vectorised, "v array<float>")
    rows = chosen.limit(2 * SAMPLE_ITEMS).toArrow().column("v").combine_chunks()
    sample = rows.values.to_numpy(zero_copy_only=False).reshape(len(rows), DIMENSIONS) if len(rows) else np.zeros((0, DIMENSIONS), np.float32)
    centres = spark.sparkContext.broadcast(topics(sample, min(TOPICS, shards)))
    within = max(1, min(PARTS // len(centres.value), shards // len(centres.value)))
    columns = items.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, top = vectors(_lists(batch.column("ids")), idf.value, mean)
            part = (v @ centres.value.T).argmax(1) * within + top * 2_654_435_761 % 4_294_967_296 % within
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], names=[*columns, "_part"])

    known = materialize(items.mapInArrow(placed, T.StructType([*items.schema.fields, T.StructField("_part", T.LongType())])), "items")
    sizes = known.groupBy("_part").agg(F.count("*").alias("_size"))
    before = range_sums(sizes, [], [F.col("_part").asc()], {"_before": "_size"})
    at = F.col("_before") + F.pmod(F.xxhash64("piece", "key"), F.col("_size"))
    return known.join(F.broadcast(before), "_part").withColumn("_shard", F.floor(at / shard_items)).select(*columns, "_shard")


def pack(tokens: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece, token_start, n_tokens, container, place, offset) of every text, packed into containers of ``capacity``.

    ``tokens`` is a stored table (key, ids) with unique keys. A text longer than a container is cut into full containers
    and a rest, and only then; every other text is one piece 0. ``container`` is named by the key and piece of its first
    member, ``place`` and ``offset`` are the piece's position and first token in it. A text without tokens (empty list or null) is
    a piece of no tokens in some container.

    Items are dealt to even shards of about ``shard_items`` by their content (``sharded``), and each shard
    is packed by one task through its own BM25 inverted index over token ids. Document frequencies and the mean length are
    those of the whole corpus; they are one number per vocabulary entry, which is what bounds the broadcast.
    """
    spark = tokens.sparkSession
    whole = tokens.select("key", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    size = F.size("ids")
    last = F.greatest(F.lit(0), F.ceil(size / capacity).cast("int") - 1)
    cut = whole.select("key", size.alias("n"), last.alias("last"), "ids")
    full = cut.where("last > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("piece"))
    full = full.select(
        "key", "piece", (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"), F.concat_ws("-", "key", "piece").alias("container"), F.lit(0).alias("place"), F.lit(0).alias("offset")
    )
    start = F.col("last") * capacity
    items = cut.select("key", F.col("last").alias("piece"), start.alias("token_start"), F.when(F.col("last") > 0, F.slice("ids", start + 1, F.lit(capacity))).otherwise(F.col("ids")).alias("ids"))

    n, total = cut.agg(F.count("*"), F.sum(F.col("n") - F.col("last") * capacity)).first()
    counted = items.select(F.explode(F.array_distinct("ids")).alias("t")).groupBy("t").count().collect()  # one row per vocabulary entry at most
    df = np.zeros(max((t for t, _ in counted), default=0) + 1)
    for t, c in counted:
        df[t] = c
    shared = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    mean = (total or 0) / max(n, 1)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("piece", "ascending")])
        ids = group.column("ids").combine_chunks()
        bounds, terms = ids.offsets.to_numpy(), _lists(ids)
        keys, pieces = group.column("key").to_pylist(), group.column("piece").to_pylist()
        rows = []
        for members in fill(np.diff(bounds), terms, shared.value, mean, capacity):
            name, offset = f"{keys[members[0]]}-{pieces[members[0]]}", 0
            for place, i in enumerate(members):
                rows.append((i, name, place, offset))
                offset += len(terms[i])
        at = pa.array([r[0] for r in rows], pa.int64())
        n_tokens = pa.array(np.diff(bounds).astype(np.int32)).take(at)
        own = [group.column(c).combine_chunks().take(at) for c in ("key", "piece", "token_start")]
        return pa.table([*own, n_tokens, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=_PLACED)

    packed = sharded(items, n, shared, mean, shard_items).groupBy("_shard").applyInArrow(
        run, "key bigint, piece int, token_start int, n_tokens int, container string, place int, offset int"
    )
    return full.unionByName(packed)


_PLACED = ["key", "piece", "token_start", "n_tokens", "container", "place", "offset"]

