"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a text that are encoded at once; a longer text is cut into leaves of about this many.
LEAF_CHARS = 16_384

#: Fixed value: how the vocabulary's text is cut into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k`` as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def shipped(spark: SparkSession, vocabulary: str | None) -> str:
    """The name of a ranks file that every worker can open: the file is sent to the executors once, whatever their disks look like."""
    path = vocabulary or default_vocabulary()
    if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return path


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The encoder of a ranks file, made once per Python worker; a file that was shipped is found by its name."""
    import tiktoken

    sent = None if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
    with open(sent or vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each token, and their lengths."""
    e = encoder(vocabulary)
    parts = [e.decode_single_token_bytes(i) for i in range(e.n_vocab)]
    return parts, np.array([len(p) for p in parts], dtype=np.int64)


# Ends of paragraphs, lines and sentences: a last character that is no blank, before the blanks that follow.
_ENDS = [re.compile(r"[^\s\x1c-\x1f](?=\r?\n\r?\n)"), re.compile(r"[^\s\x1c-\x1f](?=\r?\n)"), re.compile(r"[.!?](?= )|[\u3002\uff01\uff1f](?=[^\W_])")]


def _kind(char: str) -> str:
    """Class of a character in the word pattern: letter, number, blank or other."""
    first = unicodedata.category(char)[0]
    if first in "LN":
        return first
    return "S" if first == "Z" or char in "\t\n\v\f\r\x85" else "O"


def cut_near(text: str, middle: int, reach: int) -> tuple[int, bool] | None:
    """A place near ``middle`` to cut at, and whether the cut lies inside a word of the pattern.

    Preferred is a place where a word ends whatever stands around it: the class changes, and what stands before
    is no blank (a blank can belong to the word after it) and no apostrophe before a letter. If there is none within
    ``reach``, a place with four characters of one class on both sides: there both halves are cut into the
    same words as the whole, but for the one word that the cut divides. None if there is neither.
    """
    low, high = max(1, middle - reach), min(len(text) - 1, middle + reach)
    kinds = [_kind(c) for c in text[low - 1 : high + 1]]
    inside = None
    for step in range(reach + 1):
        for at in (middle + step, middle - step):
            if low <= at <= high:
                a, b = kinds[at - low], kinds[at - low + 1]
                if a != b and a != "S" and not (text[at - 1] == "'" and b == "L"):
                    return at, False
                if inside is None and a == b and at - low >= 3 and at + 4 <= high and len(set(kinds[at - low - 3 : at - low + 5])) == 1:
                    inside = at
    return None if inside is None else (inside, True)


def natural_cut(text: str, middle: int, reach: int) -> int | None:
    """The place nearest to ``middle``, within ``reach``, where a paragraph ends, else a line, else a sentence: before the blanks after
    it, so that a word of the pattern ends there for certain. None if there is none."""
    low, high = max(1, middle - reach), min(len(text) - 1, middle + reach)
    for pattern in _ENDS:
        found = [m.start() for m in pattern.finditer(text, low - 1, high + 1)]
        places = [i + 1 for i in found if low <= i + 1 <= high]
        if places:
            return min(places, key=lambda i: abs(i - middle))
    return None


def leaves(text: str, leaf_chars: int) -> list[tuple[int, int, bool]]:
    """Halve a text until its parts have at most ``leaf_chars`` characters: (start, end, start lies inside a word)."""
    cuts: list[tuple[int, bool]] = []
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low <= leaf_chars:
            continue
        middle = (low + high) // 2
        reach = min(leaf_chars // 4, 2048)
        natural = natural_cut(text, middle, reach)
        cut = cut_near(text, middle, reach) if natural is None else (natural, False)
        if cut is None:
            # nothing but mixed classes without a certain end for thousands of characters: look on without bound
            cut = cut_near(text, middle, max(1, (high - low) // 2 - 8))
        if cut is None or not low < cut[0] < high:
            continue
        cuts.append(cut)
        todo += [(low, cut[0]), (cut[0], high)]
    cuts = sorted(dict(cuts).items())
    starts, ends = [0, *[c for c, _ in cuts]], [*[c for c, _ in cuts], len(text)]
    return [(s, t, inside) for s, t, inside in zip(starts, ends, [False, *[x for _, x in cuts]], strict=True)]


def seam(left: np.ndarray, right: np.ndarray, vocabulary: str) -> tuple[int, np.ndarray, int] | None:
    """How two encoded halves of one word join: (tokens dropped of left, tokens in between, tokens dropped of right).

    A growing window around the join is encoded again, until its tokens begin as the left side's window does and end
    as the right side's. Neighbouring tokens of a BPE encoding are each other's encoding, and a sequence all of
    whose neighbours are is the encoding of the whole; so two common tokens at either end prove the result.
    None if the sides don't agree within the given tokens.
    """
    e, (parts, _) = encoder(vocabulary), token_bytes(vocabulary)
    w = 8
    while w <= min(len(left), len(right)):
        a, b = left[-w:], right[:w]
        ids = np.array(e._encode_single_piece(b"".join(parts[i] for i in [*a, *b])), dtype=np.int32)
        if len(ids) >= 4 and ids[:2].tolist() == a[:2].tolist() and ids[-2:].tolist() == b[-2:].tolist():
            return w, ids, w
        w *= 2
    return None


def word_edges(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """Tokens at the start and at the end of an encoded leaf that surely lie inside its first and last word."""

    def run(chars) -> int:
        n, first = 0, None
        for c in chars:
            first = first or _kind(c)
            if _kind(c) != first:
                break
            n += len(c.encode())
        return max(0, n - 3)  # the outer end of the run may belong to another word, as 're does

    size = lengths[ids]
    head = int(np.searchsorted(np.cumsum(size), run(text), "right"))
    tail = int(np.searchsorted(np.cumsum(size[::-1]), run(reversed(text)), "right"))
    return head, tail


def joined(parts: list[tuple[np.ndarray, bool, int, int]], vocabulary: str) -> np.ndarray:
    """The encoding of a text from its encoded leaves (ids, start lies inside a word, head, tail), pairwise as a tree.

    ``head`` and ``tail`` are the tokens that may change at a join (``word_edges``). Where those don't suffice, the two
    sides are encoded again as a whole.
    """
    while len(parts) > 1:
        merged = []
        for (a, inside, head, tail), (b, cut, b_head, b_tail) in zip(parts[::2], parts[1::2]):
            if not cut:
                merged.append((np.concatenate([a, b]), inside, head, b_tail))
            elif found := seam(a[len(a) - tail :], b[:b_head], vocabulary):
                x, between, y = found
                ids = np.concatenate([a[: len(a) - x], between, b[y:]])
                merged.append((ids, inside, min(head, len(a) - x), min(b_tail, len(b) - y)))
            else:
                text = b"".join(token_bytes(vocabulary)[0][i] for i in [*a, *b]).decode()
                merged.append((encode_text(text, vocabulary), inside, 0, 0))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return parts[0][0]


def encode_text(text: str, vocabulary: str) -> np.ndarray:
    return encoder(vocabulary).encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def _encode_rows(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids = [encode_text(t.as_py() or "", vocabulary) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(ids)], names=["key", "ids"])

    return run


def _leaf_rows(leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                parts = leaves(text, leaf_chars)
                divided = any(inside for _, _, inside in parts)
                for i, (low, high, inside) in enumerate(parts):
                    row = {"key": key, "leaf": i, "inside": inside, "divided": divided, "before": text[max(0, low - 3) : low], "after": text[high : high + 1], "text": text[low:high]}
                    yield pa.RecordBatch.from_pylist([row], schema=_LEAF)

    return run


def _encode_leaves(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_bytes(vocabulary)[1]
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = one.column("text")[0].as_py()
                ids = encode_text(text, vocabulary)
                head, tail = word_edges(text, ids, lengths)
                yield pa.RecordBatch.from_arrays([*one.columns[:6], pa.array([head], pa.int32()), pa.array([tail], pa.int32()), _id_lists([ids])], schema=_ENCODED)

    return run


def _join_leaves(vocabulary: str):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["leaf", "inside", "head", "tail"]).to_pylist(), key=lambda r: r["leaf"])
        at = {leaf: i for i, leaf in enumerate(group.column("leaf").to_pylist())}
        ids = group.column("ids").combine_chunks()
        parts = [(ids[at[r["leaf"]]].values.to_numpy(zero_copy_only=False), r["inside"], r["head"], r["tail"]) for r in rows]
        return pa.table([group.column("key").slice(0, 1), _id_lists([joined(parts, vocabulary)])], names=["key", "ids"])

    return run


_PLACE = [("key", pa.int64()), ("leaf", pa.int32()), ("inside", pa.bool_()), ("divided", pa.bool_()), ("before", pa.string()), ("after", pa.string())]
_LEAF = pa.schema([*_PLACE, ("text", pa.string())])
_ENCODED = pa.schema([*_PLACE, ("head", pa.int32()), ("tail", pa.int32()), ("ids", pa.list_(pa.int32()))])
#: ``before`` and ``after`` are the characters around the leaf; ``inside`` says that it starts inside a word, ``divided`` that any leaf of the text does.
ENCODED_LEAF = "key bigint, leaf int, inside boolean, divided boolean, before string, after string, head int, tail int, ids array<int>"


def cut_leaves(df: DataFrame, key: str, text: str, leaf_chars: int) -> DataFrame:
    """(key, leaf, inside, divided, before, after, text): the leaves of texts longer than ``leaf_chars``, dealt to tasks one by one."""
    long = df.where(F.length(text) > leaf_chars).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return long.mapInArrow(_leaf_rows(leaf_chars), "key bigint, leaf int, inside boolean, divided boolean, before string, after string, text string").repartition("key", "leaf")


def encoded_leaves(df: DataFrame, key: str, text: str, vocabulary: str, leaf_chars: int) -> DataFrame:
    """(ENCODED_LEAF): the encoded leaves of texts longer than ``leaf_chars``, spread over tasks."""
    return cut_leaves(df, key, text, leaf_chars).mapInArrow(_encode_leaves(vocabulary), ENCODED_LEAF)


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(key bigint, ids array<int>) of every row's text, without special tokens; null and empty texts have an empty list.

    ``key`` should be unique; a null key passes through. Strings that look like special tokens are ordinary text. Equal to
    encoding each text as a whole.

    Texts of up to ``leaf_chars`` characters are encoded where they lie. Longer ones are halved, again and again, preferably
    where a word ends for certain; the parts are shuffled and encoded in parallel and joined as a tree, and joins inside a
    word (long text without blanks) are repaired by re-encoding growing windows until both sides agree.
    """
    vocabulary = shipped(df.sparkSession, vocabulary)
    short = df.where(F.coalesce(F.length(text), F.lit(0)) <= leaf_chars).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    direct = short.mapInArrow(_encode_rows(vocabulary), "key bigint, ids array<int>")
    rest = encoded_leaves(df, key, text, vocabulary, leaf_chars).groupBy("key").applyInArrow(_join_leaves(vocabulary), "key bigint, ids array<int>")
    return direct.unionByName(rest)
