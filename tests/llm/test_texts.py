import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm.packing import fill, pack, sharded
from tracewell.llm.splitting import LINE, PARAGRAPH, SENTENCE, cuts, split_texts, strengths
from tracewell.llm.tokens import default_vocabulary, encode, encode_text, joined, leaves, token_bytes, word_edges

V = default_vocabulary()
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "0123456789", "中文字符测试的是一不", "a1", "'stre ", "!?.'-= ,", " \n\t", "éàüñΩжщ", "😀🎉a ", "don't we'll ", "\x1c\x1d a​"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join("".join(rng.choice(a) for _ in range(rng.randint(1, 1500))) for a in rng.choices(ALPHABETS, k=2)) for _ in range(n)]


def test_joined_leaves_equal_the_whole():
    lengths = token_bytes(V)[1]
    for text in [*texts(150, 1), "x" * 9000, "ab" * 4000, "中" * 4000, "'s" * 3000]:
        for size in (32, 500):
            parts = []
            for a, b, inside in leaves(text, size):
                ids = encode_text(text[a:b], V)
                parts.append((ids, inside, *word_edges(text[a:b], ids, lengths)))
            assert joined(parts, V).tolist() == encode_text(text, V).tolist()


def documents(spark):
    rows = [*enumerate(texts(40, 2)), (100, None), (101, ""), (102, " \r\n "), (103, "<|endoftext|> x"), (104, "word " * 9000), (105, "Ab3" * 9000), (106, "same"), (107, "same"), (108, "Line one.\nLine two. And more\n\n" * 400), (None, "no key")]
    return rows, spark.createDataFrame(rows, "k bigint, text string")


def test_encode(spark):
    rows, df = documents(spark)
    got = {r.key: list(r.ids) for r in encode(df, "k", "text", leaf_chars=700).collect()}
    assert got == {k: encode_text(t or "", V).tolist() for k, t in rows}
    assert got[100] == got[101] == [] and encode(df.limit(0), "k", "text").count() == 0


@pytest.mark.parametrize("leaf", [1000, 10**9])
def test_pieces(spark, leaf):
    rows, df = documents(spark)
    pieces = {}
    for r in split_texts(df.where("k is not null"), "k", "text", leaf_chars=leaf).collect():
        pieces.setdefault(r.key, []).append(r)
    for k, t in rows:
        ids = encode_text(t or "", V).tolist()
        own = sorted(pieces.get(k, []), key=lambda r: r.piece)
        if k is None or len(ids) <= 512:
            assert not own
            continue
        assert own[0].token_start == 0 and own[-1].token_end == len(ids)
        for r in own:
            assert list(r.ids) == ids[r.token_start : r.token_end] and len(r.ids) <= 512
            assert t.encode()[r.byte_start : r.byte_end].decode("utf-8", "replace") == r.text
        assert all(a.token_end - b.token_start == 64 for a, b in zip(own, own[1:]))
    assert all(r.text.endswith(("\n\n", "more")) for r in pieces[108][:-1])


def split_plainly(text, leaf):
    """Token ranges of the pieces of a text cut into ranges, without Spark; None where a cut lies inside a word."""
    lengths, parts = token_bytes(V)[1], leaves(text, leaf)
    if any(inside for _, _, inside in parts):
        return None
    out, base = [], 0
    for i, (low, high, _) in enumerate(parts):
        ids = encode_text(text[low:high], V)
        if len(ids) < 64 and high < len(text):
            return None
        carried = 64 if i else 0
        every = strengths(text.encode(), len(text[:low].encode()) + np.cumsum(lengths[ids]))
        out += [(base - carried + a, base - carried + b) for a, b in cuts(np.concatenate([np.zeros(carried, np.int8), every]), 512, 64)]
        base += len(ids)
    return out if base > 512 else []


@pytest.mark.parametrize("leaf", [900, 4000])
def test_ranges_emit_the_pieces_of_a_plain_loop(spark, leaf):
    rows, df = documents(spark)
    got, plain = {}, 0
    for r in split_texts(df.where("k is not null"), "k", "text", leaf_chars=leaf).collect():
        got.setdefault(r.key, []).append((r.piece, r.token_start, r.token_end))
    for k, t in rows:
        if k is not None and t and len(t) > leaf and (want := split_plainly(t, leaf)) is not None:
            plain += bool(want)
            assert sorted(got.get(k, [])) == [(i, *p) for i, p in enumerate(want)]
    assert plain >= 3


def test_range_ends_are_natural():
    text = "One line.\nAnother. And more\n\n" * 300
    assert all(text[b:].startswith("\n\n") for _, b, _ in leaves(text, 1000)[:-1])
    flat = "Some words here. " * 500
    assert all(flat[b - 1] == "." for _, b, _ in leaves(flat, 1000)[:-1])


def test_strengths_and_cuts():
    data = b"a. b\n\nc\xe4\xb8\xad"
    got = strengths(data, np.arange(1, len(data) + 1)).tolist()
    assert got[1] == SENTENCE and got[5] == PARAGRAPH and got[7:9] == [-1, -1] and got[4] != LINE
    assert cuts(np.zeros(20, np.int8), 10, 2) == [(0, 10), (8, 18), (16, 20)]
    with pytest.raises(ValueError):
        split_texts(None, "k", "text", 10, 5)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 200) for _ in range(rng.choice([0, 1, 5, 40, 90, 100, 101, 350]))]) for i in range(600)] + [(1000, None)]
    df = spark.createDataFrame(rows, "key bigint, ids array<int>").cache()
    placed = pack(df, 100, shard_items=150).collect()
    boxes, texts_ = {}, {}
    for r in placed:
        boxes.setdefault(r.container, []).append(r)
        texts_.setdefault(r.key, []).append(r)
    assert set(texts_) == {k for k, _ in rows}
    for k, ids in rows:
        own = sorted(texts_[k], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == len(ids or []) and len(own) == max(1, -(-len(ids or []) // 100))
        assert [r.token_start for r in own] == [100 * i for i in range(len(own))]
    for own in boxes.values():
        own.sort(key=lambda r: r.place)
        assert [r.offset for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))] and sum(r.n_tokens for r in own) <= 100
    assert pack(df.limit(0)).count() == 0


def test_neighbours_share_a_container():
    terms = [np.array([t] * 5 + [i]) for t in range(10) for i in range(3)]
    boxes = fill(np.full(30, 6), terms, np.ones(100), 6.0, 18)
    assert all(len({terms[i][0] for i in b}) == 1 and len(b) == 3 for b in boxes)


def test_shards_hold_texts_of_like_content(spark):
    rng = random.Random(9)
    rows = [(i, [1000 * (i % 10) + rng.randint(0, 60) for _ in range(40)] + [rng.randint(20_000, 20_030) for _ in range(10)]) for i in range(1000)] + [(5000 + i, [7, 8, 9]) for i in range(500)]
    items = spark.createDataFrame(rows, "key bigint, ids array<int>").withColumn("piece", F.lit(0)).cache()
    idf = spark.sparkContext.broadcast(np.ones(20_100))
    shard = {r.key: r._shard for r in sharded(items, 1500, idf, 50.0, 100).collect()}
    sizes = np.bincount(list(shard.values()))
    assert len(shard) == 1500 and sizes.max() < 160 and len(sizes) >= 14
    nearest = 0
    for k, ids in rows[:200]:
        best = max((x for x in rows[:1000] if x[0] != k), key=lambda x: len(set(ids) & set(x[1])))
        nearest += abs(shard[best[0]] - shard[k]) <= 1
    assert nearest > 150  # by chance it would be 40
