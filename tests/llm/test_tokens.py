"""Byte-level BPE and packing."""

import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.llm import bpe_tree, packing

RANKS, JSON = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")
TREE = bpe_tree.tree_bpe(RANKS, public.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=TREE.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n\t\x1c\x85'séß0", max_size=200))
def test_encodes_like_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert TREE.encode(text) == REAL.encode_ordinary(text)
    assert TREE.decode(TREE.encode(text)).decode() == text


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_any_leaf_size_gives_the_same_ids(leaf):
    rng = random.Random(leaf)
    tree = bpe_tree.TreeBPE(TREE.ranks, public.PATTERN, leaf)
    for _ in range(300):
        data = bytes(rng.choice(b"abc the\xc3\xa9 ") for _ in range(rng.choice([1, 5, 40, 200])))
        assert tree.encode_bytes(data) == TREE.merge(data)


def test_long_pieces():
    for text in ("a" * 5000, "=-" * 4000, "the" * 3000, " " * 7001 + "x"):
        assert TREE.encode(text) == REAL.encode_ordinary(text)


def test_encode_and_decode_tables(spark, edge_docs, no_docs, edge_rows):
    clash = edge_docs.withColumn("ids", F.lit("taken"))
    got = bpe_tree.decode(bpe_tree.encode(clash, RANKS, public.PATTERN), RANKS, public.PATTERN).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert r["ids"] == REAL.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe_tree.encode(no_docs, RANKS, public.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert bytes(bpe_tree.decode(nothing, RANKS, public.PATTERN).first()["decoded"]) == b""


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 5) == [(0, 5)]
    assert packing.cut(11, 5) == [(0, 1), (1, 5), (6, 5)]
    assert packing.cut(0, 5) == []


def test_sum_of_squares_rule():
    # gaps after 6 and 5 are 4 and 5; 4 fits the gap 4 exactly, and filled sequences count for nothing
    sequence, offset, gaps = packing.sum_of_squares(np.array([6, 5, 4, 10]), 10)
    assert sequence.tolist() == [0, 1, 0, 2] and offset.tolist() == [0, 0, 6, 0] and gaps.tolist() == [0, 5, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_sum_of_squares_places_everything(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset, gaps = packing.sum_of_squares(lengths, 32)
    used = np.bincount(sequence, lengths, len(gaps)) if len(lengths) else np.zeros(0)
    assert (32 - used == gaps).all() and (gaps >= 0).all()
    for k in range(len(gaps)):
        own = sorted(zip(offset[sequence == k], lengths[sequence == k]))
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()


def test_pieces_and_packing(spark, edge_docs, no_docs, edge_rows):
    from tokenizers import Tokenizer
    real = Tokenizer.from_file(JSON)
    want = sorted((str(i), [*real.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in edge_rows)
    cut = packing.pieces(edge_docs, JSON, capacity=256)
    rows = packing.pack(cut.withColumn("offset", F.lit("taken")), 256, per_shard=64).collect()
    docs = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        docs.setdefault((str(r["doc_id"]), r["piece"]), []).append(r["ids"])
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in rows) == total
    for name, ids in want:
        if name not in ("None", "5"):       # ids that rows share
            parts = [docs[name, k][0] for k in range(len(packing.cut(len(ids), 256)))]
            assert [i for p in parts for i in p] == ids
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 256
    assert len(bins) <= total / 256 * 1.02 + 2
    assert packing.pack(packing.pieces(no_docs, JSON)).count() == 0


@pytest.mark.parametrize("low,high", [(1100, 1500), (650, 1100), (300, 2048)])
def test_shards_need_hardly_more_sequences_than_one(spark, low, high):
    rng = np.random.default_rng(low)
    lengths = rng.integers(low, high + 1, 4000)
    cut = spark.createDataFrame([(int(n),) for n in lengths], "length long")
    rows = packing.pack(cut, per_shard=500).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["length"] for r in rows) == sorted(lengths.tolist())
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    one = len(packing.sum_of_squares(np.sort(lengths)[::-1], 2048)[2])
    assert len(bins) <= 1.01 * one


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer
    real = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  c\n", " <|endoftext|> ", "<|endoftext| >", "<|endoftext|", "a b",
             "plain words", "one two <|endoftext|>three four " * 50]
    want = [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for ids in (packing.Ids(JSON), packing.Ids(JSON, RANKS, public.PATTERN)):
        for _ in range(2):
            assert [np.frombuffer(own, "<u4").tolist() for own in ids.encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for more in ({}, {"ranks_path": RANKS, "pattern": public.PATTERN}):
        got = {r["doc_id"]: r["ids"] for r in packing.pieces(docs, JSON, **more).collect()}
        assert [got[i] for i in range(len(texts))] == [[*ids, 0] for ids in want]


def test_query_digests_equal_tiktoken(spark, tmp_path, edge_rows):
    import hashlib

    import public_tokenizers as public
    import tiktoken
    from panelcast.llm import bpe_tree
    from panelcast.llm.queries import QUERIES
    path = public.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe_tree.load_ranks(path), special_tokens={})
    rows = [(i, r[1]) for i, r in enumerate(edge_rows)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op1_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = encoder.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
