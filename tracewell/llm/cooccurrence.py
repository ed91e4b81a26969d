"""Items that appear together: pair counts and their ratio to chance, by a blocked Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Items of one record that are put into one block; a record with more is cut into several blocks.
BLOCK_ITEMS = 256
#: Entries of a partial product that are held at once.
_ENTRIES = 4_000_000
#: Blocks with at least this share of ones are multiplied densely.
_DENSE = 0.125
_PAIRS = pa.schema([("item_a", pa.int64()), ("item_b", pa.int64()), ("n", pa.int64())])


class _Rows:
    """A binary sparse block in compressed rows: ``columns[starts[r] : starts[r] + sizes[r]]`` are the ones of row ``r``."""

    def __init__(self, columns: np.ndarray, offsets: np.ndarray):
        self.columns, self.starts, self.sizes = columns, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)

    def part(self, low: int, high: int) -> _Rows:
        at = np.append(self.starts[low:high], self.starts[high - 1] + self.sizes[high - 1])
        return _Rows(self.columns[at[0] : at[-1]], at - at[0])

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.sizes), width), dtype=np.float32)
        out[np.repeat(np.arange(len(self.sizes)), self.sizes), self.columns] = 1
        return out


def _product(x: _Rows, y: _Rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero entries of X'Y as (row * width + column, value).

    A full enough block goes through a dense product (exact in single precision, as a block has far fewer than 2**24 rows). Else every one of
    X is expanded by its row of Y, and equal entries are sorted together and summed.
    """
    cells = len(x.sizes) * width
    if cells and min(len(x.columns), len(y.columns)) >= _DENSE * cells:
        whole = x.dense(width).T @ y.dense(width)
        code = np.flatnonzero(whole)
        return code, whole.ravel()[code].astype(np.int64)
    reps = np.repeat(y.sizes, x.sizes)
    first = np.repeat(y.starts, x.sizes)
    at = np.repeat(first - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    return np.unique(np.repeat(x.columns, reps) * width + y.columns[at], return_counts=True)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transposed products of record blocks, summed over the blocks of a batch: X'X, or X'Y for two item blocks of large records.

    A row without other items is a whole record, to be multiplied with itself; of X'X the part above the diagonal counts.
    """

    def entries(codes: list[np.ndarray], values: list[np.ndarray], items: np.ndarray) -> pa.RecordBatch:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(values), len(code)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(items[code // len(items)]), pa.array(items[code % len(items)]), pa.array(n)], schema=_PAIRS)

    for batch in batches:
        left, right = (c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in batch.columns)
        offsets = [c.offsets.to_numpy() - c.offsets[0].as_py() for c in batch.columns]
        items, local = np.unique(np.concatenate([left, right]), return_inverse=True)
        width = len(items)
        x, other = _Rows(local[: len(left)], offsets[0]), _Rows(local[len(left) :], offsets[1])
        own = other.sizes == 0
        codes: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0
        work = np.cumsum(x.sizes * np.where(own, x.sizes, other.sizes))
        low = 0
        while low < len(own):
            done = work[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(work, done + _ENTRIES, "right")))
            same = own[low:high]
            if same.all() or not same.any():
                runs = [(low, high)]
            else:  # whole records and item blocks in turn
                edges = low + 1 + np.flatnonzero(np.diff(same.astype(np.int8)))
                runs = list(zip([low, *edges.tolist()], [*edges.tolist(), high], strict=True))
            for a, b in runs:
                block = x.part(a, b)
                code, n = _product(block, block if own[a] else other.part(a, b), width)
                i, j = code // width, code % width
                if own[a]:
                    i, j, n = i[i < j], j[i < j], n[i < j]
                codes.append(np.minimum(i, j) * width + np.maximum(i, j))
                values.append(n)
                held += len(n)
            low = high
            if held >= _ENTRIES:
                yield entries(codes, values, items)
                codes, values, held = [], [], 0
        if held:
            yield entries(codes, values, items)


def _tiles(kept: DataFrame, block_items: int, partitions: int) -> DataFrame:
    """(items, others) of (record, item): whole small records without others, and all blocks of large ones, alone and with each other."""
    sizes = kept.groupBy("record").agg(F.count("*").alias("size")).where("size > 1")
    cut = kept.join(sizes, "record").withColumn("blocks", F.ceil(F.col("size") / block_items).cast("int"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("item"), F.col("blocks"))).otherwise(0).cast("int")
    blocks = cut.groupBy("record", "blocks", block.alias("block")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<bigint>")
    own = blocks.select("items", none.alias("others"))
    # each block of a large record meets every other one of it in a task of their own; the number keeps the parts from being put together again
    met = blocks.where("blocks > 1").select("record", "block", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
    met = met.select("record", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") < F.col("other")).alias("first"), "items")
    dealt = met.repartition(partitions, "record", "i", "j")
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("items")))
    across = dealt.groupBy("record", "i", "j").agg(side(True).alias("items"), side(False).alias("others")).where("items is not null and others is not null")
    return own.unionByName(across.select("items", "others"))


def cooccurrence(pairs: DataFrame, record: str, item: str, min_count: int = 8, min_ratio: float = 15.0, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_records, ratio) of the item pairs found together in enough records.

    ``item_a < item_b`` (bigint ids); ``n_ab`` records hold both, ``n_a`` and ``n_b`` hold each, ``n_records`` hold any
    item; ``ratio = n_ab * n_records / (n_a * n_b)`` is how much more often than by chance. Pairs with
    ``n_ab >= min_count`` and ``ratio >= min_ratio`` come out, compared without rounding. Repeated rows count once, rows
    with a null record or item not at all; an empty input gives no rows.

    Two bounds cut items before any product, without losing a pair: an item in fewer than ``min_count`` records has
    no pair that frequent, and one in more than ``n_records / min_ratio`` has none that far above chance (this takes
    out the hot items). Each record's items form sparse binary blocks of about ``block_items`` items; a record with
    several blocks is dealt to tasks by (record, block, block), so a record of any size is spread. Products of record blocks
    are summed per block, in the map-side combine, and after the shuffle.
    """
    spark = pairs.sparkSession
    known = materialize(pairs.select(F.col(record).alias("record"), F.col(item).cast("bigint").alias("item")).dropna().distinct(), "baskets")
    support = materialize(known.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "support")
    n_records = known.select("record").distinct().count()
    usable = support.where(F.col("n") * F.lit(float(min_ratio)) <= n_records * (1 + 1e-9)) if min_ratio > 0 else support
    kept = known.join(usable.select("item"), "item", "left_semi")
    tiles = _tiles(kept, block_items, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = tiles.mapInArrow(_gram, "item_a bigint, item_b bigint, n bigint").groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab"))
    frequent = counts.where(F.col("n_ab") >= min_count)
    with_a = frequent.join(usable.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
    both = with_a.join(usable.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    whole = both.withColumn("n_records", F.lit(n_records).cast("bigint"))
    observed = F.col("n_ab").cast("decimal(19,0)") * F.col("n_records").cast("decimal(18,0)")
    chance = F.col("n_a").cast("decimal(14,0)") * F.col("n_b").cast("decimal(14,0)") * F.lit(str(min_ratio)).cast("decimal(10,4)")
    lifted = whole.where(observed >= chance)
    ratio = F.col("n_ab").cast("double") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    return lifted.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", ratio.alias("ratio"))
