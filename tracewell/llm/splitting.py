"""Splitting long texts into pieces of tokens at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import LEAF_CHARS, cut_leaves, encode_text, joined, shipped, token_bytes, word_edges

LIMIT, OVERLAP = 512, 64
_PIECES = pa.schema(
    [("key", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())]
)
_ROW = "key bigint, piece int, token_start bigint, token_end bigint, byte_start bigint, byte_end bigint, ids array<int>, text string"
# Strength of a place to cut at, by what stands there.
INSIDE_CHARACTER, NONE, BLANK, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3, 4


def strengths(data: bytes, ends: np.ndarray, before: bytes = b"", after: bytes = b"") -> np.ndarray:
    """Strength of the boundary at each byte offset of ``ends`` in ``data``, whose surroundings are ``before`` and ``after``."""
    b = np.frombuffer(b"\0\0\0" + before + data + after + b"\0", dtype=np.uint8)
    at = ends + 3 + len(before)
    p1, p2, p3, nxt = b[at - 1], b[at - 2], b[at - 3], b[at]
    blank = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    stop = (p1 == 46) | (p1 == 33) | (p1 == 63)
    # the full stops of Chinese text: U+3002, U+FF01, U+FF1F
    wide = ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)))
    out = np.where(blank(p1) | blank(nxt), BLANK, NONE)
    out = np.where((stop & blank(nxt)) | wide, SENTENCE, out)
    out = np.where((p1 == 10) & ~((nxt == 10) | (nxt == 13)), LINE, out)
    out = np.where((p1 == 10) & ((p2 == 10) | ((p2 == 13) & (p3 == 10))) & ~((nxt == 10) | (nxt == 13)), PARAGRAPH, out)
    return np.where((nxt & 0xC0) == 0x80, INSIDE_CHARACTER, out).astype(np.int8)


def cuts(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges (start, end) of the pieces of a text with these boundary strengths after its tokens.

    A piece ends at the strongest boundary of the later half of what it may hold, the last of equals; if there is no
    natural one, at the strongest in all of it that still makes progress; else anywhere between two characters. The
    next piece starts ``overlap`` tokens earlier.
    """
    n, start, out = len(strength), 0, []
    while n - start > limit:
        ends = None
        for low in (start + max(limit // 2, overlap + 1), start + overlap + 1):
            window = strength[low - 1 : start + limit]
            best = window.max()
            end = low + len(window) - 1 - int(np.argmax(window[::-1] == best))
            if ends is None or best > NONE:
                ends = end
            if best > NONE:
                break
        out.append((start, ends))
        start = ends - overlap
    return [*out, (start, n)]


class _Rows:
    """Pieces collected into record batches."""

    def __init__(self, vocabulary: str):
        self.parts, self.lengths = token_bytes(vocabulary)
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []

    def add(self, key: int, ids: np.ndarray, ranges: list[tuple[int, int]], piece: int = 0, token: int = 0, byte: int = 0) -> None:
        """The pieces ``ranges`` of these tokens, the first of which is the text's token ``token`` at byte ``byte``."""
        ends = byte + np.concatenate([[0], np.cumsum(self.lengths[ids])])
        for i, (a, b) in enumerate(ranges):
            text = b"".join([self.parts[t] for t in ids[a:b]]).decode("utf-8", "replace")
            self.rows.append((key, piece + i, token + a, token + b, int(ends[a]), int(ends[b]), text))
            self.ids.append(ids[a:b])

    def batch(self) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.ids) if self.ids else np.empty(0), pa.int32()))
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 7
        columns.insert(6, ids)
        self.rows, self.ids = [], []
        return pa.RecordBatch.from_arrays([c if f.name == "ids" else pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


_FLUSH = 2000
_RANGE = "key bigint, leaf int, inside boolean, divided boolean, head int, tail int, n_bytes bigint, ids array<int>, strength array<smallint>, ends array<int>"


def _bounded(vocabulary: str, limit: int, overlap: int):
    """Encode the ranges, find their boundaries, and cut them: ``ends`` are the ends of their pieces, counted from the range's first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_bytes(vocabulary)[1]
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                text, before, after, leaf = (one.column(c)[0].as_py() for c in ("text", "before", "after", "leaf"))
                data, ids = text.encode(), encode_text(text, vocabulary)
                strength = strengths(data, np.cumsum(lengths[ids]), before.encode(), after.encode())
                carried = overlap if leaf else 0
                ends = [b - carried for _, b in cuts(np.concatenate([np.zeros(carried, np.int8), strength]), limit, overlap)]
                head, tail = word_edges(text, ids, lengths)
                own = [one.column(c) for c in ("key", "leaf", "inside", "divided")]
                lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int32()), (strength.astype(np.int16), pa.int16()), (ends, pa.int32()))]
                scalars = [pa.array([head], pa.int32()), pa.array([tail], pa.int32()), pa.array([len(data)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *scalars, *lists], names=["key", "leaf", "inside", "divided", "head", "tail", "n_bytes", "ids", "strength", "ends"])

    return run


def _emitted(vocabulary: str, overlap: int):
    """Pieces of ranges by their offsets in the text; ``carry`` holds the last tokens of the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(vocabulary)
        for batch in batches:
            keys, leaves, pieces, tokens, bytes_ = (batch.column(c).to_pylist() for c in ("key", "leaf", "piece_base", "token_base", "byte_base"))
            for r in range(batch.num_rows):
                ids, ends, carry = (batch.column(c)[r].values for c in ("ids", "ends", "carry"))
                ids, ends = ids.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False)
                carried = 0
                if leaves[r]:
                    before = carry.to_numpy(zero_copy_only=False)
                    ids, carried = np.concatenate([before, ids]), len(before)
                starts = np.concatenate([[0], ends[:-1] + carried - overlap])
                ranges = list(zip(starts.tolist(), (ends + carried).tolist(), strict=True))
                out.add(keys[r], ids, ranges, pieces[r], tokens[r] - carried, bytes_[r] - int(out.lengths[ids[:carried]].sum()))
                if len(out.rows) >= _FLUSH:
                    yield out.batch()
        yield out.batch()

    return run


def _whole(vocabulary: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(vocabulary)
        for batch in batches:
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_text(t := cell.as_py(), vocabulary)
                if len(ids) > limit:
                    out.add(k, ids, cuts(strengths(t.encode(), np.cumsum(out.lengths[ids])), limit, overlap))
                if len(out.rows) >= _FLUSH:
                    yield out.batch()
        yield out.batch()

    return run


def _stitched(vocabulary: str, limit: int, overlap: int):
    """Pieces of one text whose ranges can't be cut apart: the joins are repaired and the boundary tables put together by byte offset."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        rows, ids = group.select(["inside", "head", "tail"]).to_pylist(), group.column("ids").combine_chunks()
        leaves = [ids[i].values.to_numpy(zero_copy_only=False) for i in range(len(rows))]
        all_ids = joined([(x, r["inside"], r["head"], r["tail"]) for x, r in zip(leaves, rows, strict=True)], vocabulary)
        if len(all_ids) <= limit:
            return _PIECES.empty_table()
        # tokens that a repaired join made lie inside a word and end at no boundary
        lengths = token_bytes(vocabulary)[1]
        found = group.column("strength").combine_chunks()
        base, offsets, values = 0, [], []
        for i, x in enumerate(leaves):
            ends = base + np.cumsum(lengths[x])
            offsets.append(ends)
            values.append(found[i].values.to_numpy(zero_copy_only=False))
            base = int(ends[-1]) if len(ends) else base
        offsets, values = np.concatenate(offsets), np.concatenate(values)
        ends = np.cumsum(lengths[all_ids])
        at = np.minimum(np.searchsorted(offsets, ends), len(offsets) - 1)
        strength = np.where(offsets[at] == ends, values[at], INSIDE_CHARACTER).astype(np.int8)
        out = _Rows(vocabulary)
        out.add(group.column("key")[0].as_py(), all_ids, cuts(strength, limit, overlap))
        return pa.Table.from_batches([out.batch()])

    return run


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(key, piece, token_start, token_end, byte_start, byte_end, ids, text) of the pieces of texts over ``limit`` tokens.

    Consecutive pieces share exactly ``overlap`` tokens of the text's encoding, and each has at most ``limit``. They end
    after a paragraph, a line, a sentence or a blank, wherever their range holds one, and never inside a character if
    that can be helped. ``byte_start`` and ``byte_end`` are offsets in the text's UTF-8; a character that a piece's start
    divides is a replacement character in ``text``. Null, empty and short texts have no pieces; keys should be unique.

    A text of up to ``leaf_chars`` is split where it lies (not even encoded if it has no more bytes than ``limit``). A longer one is first
    cut into ranges, each at the end of a paragraph, line, sentence or word near the middle of what is left, and a range's end is the
    end of a piece too. So every range is encoded, searched for boundaries and cut by a task of its own, which sees three characters before it and
    one after it as its halo; the tables of all ranges, a small row for each, are stitched by sums over the ranges before (tokens,
    bytes, pieces), and every range emits its pieces at those offsets. Only texts that had to be cut inside a word, or hold a range of
    fewer than ``overlap`` tokens, are put together in one task, as token ids and boundary strengths.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    vocabulary = shipped(df.sparkSession, vocabulary)
    short = df.where((F.octet_length(text) > limit) & (F.length(text) <= leaf_chars)).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ranges = materialize(cut_leaves(df, key, text, leaf_chars).mapInArrow(_bounded(vocabulary, limit, overlap), _RANGE), "ranges")
    own = Window.partitionBy("key").orderBy("leaf")
    before, every = own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    n = F.size("ids")
    last = F.slice("ids", F.greatest(F.lit(1), n - overlap + 1), F.lit(max(overlap, 1)))
    rows = ranges.select("key", "leaf", "divided", n.cast("bigint").alias("n"), "n_bytes", F.size("ends").alias("n_pieces"), last.alias("last"))
    few = (F.col("n") < overlap) & F.lead("leaf").over(own).isNotNull()
    table = rows.withColumn("few", few).select(
        "key",
        "leaf",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("token_base"),
        F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("n_pieces").over(before), F.lit(0)).alias("piece_base"),
        F.coalesce(F.lag("last").over(own), F.array().cast("array<int>")).alias("carry") if overlap else F.array().cast("array<int>").alias("carry"),
        F.sum("n").over(every).alias("total"),
        F.max(F.col("divided") | F.col("few")).over(every).alias("together"),
    )
    stored = materialize(table, "offsets")
    apart = ranges.select("key", "leaf", "ids", "ends").join(stored.where(~F.col("together") & (F.col("total") > limit)).drop("together", "total"), ["key", "leaf"])
    joint = ranges.join(stored.where("together").select("key").distinct(), "key", "left_semi").drop("divided", "n_bytes", "ends")
    pieces = short.mapInArrow(_whole(vocabulary, limit, overlap), _ROW).unionByName(apart.mapInArrow(_emitted(vocabulary, overlap), _ROW))
    return pieces.unionByName(joint.groupBy("key").applyInArrow(_stitched(vocabulary, limit, overlap), _ROW))
