"""Substring and near-duplicate removal against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import components, minhash, superkmer
from panelcast.llm.common import words


def brute_cut(texts, window):
    docs = [words(t) for t in texts]
    seen = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def cut(docs, **options):
    return superkmer.attach(docs, superkmer.kept_texts(docs, **options))


@pytest.mark.parametrize("hot", [512, 2])
def test_substrings_of_edge_rows(spark, edge_docs, edge_rows, hot):
    clash = edge_docs.withColumn("kept", F.lit("taken")).withColumn("h1", F.lit(1))
    got = cut(clash, hot=hot).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = brute_cut([r[1] for r in edge_rows], 35)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((str(r[0]), r[1], r[2], bytes(r[3])) for r in got) == sorted(key((e[0], *w)) for e, w in zip(edge_rows, want))


@pytest.mark.parametrize("seed,hot", [(1, 512), (2, 3)])
def test_substrings_of_small_alphabets(spark, seed, hot):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randrange(60)))) for i in range(120)]
    got = cut(spark.createDataFrame(rows, "doc_id long, text string"), window=7, mer=3, hot=hot).collect()
    want = {i: w for (i, _), w in zip(rows, brute_cut([t for _, t in rows], 7))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got} == want


def test_deduplicate_keeps_texts_that_lose_nothing(spark, no_docs):
    docs = spark.createDataFrame([(1, "a  b\nc", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["text"] for r in superkmer.deduplicate(docs).collect()} == {1: "a  b\nc", 2: ""}
    assert superkmer.deduplicate(no_docs).count() == 0


def shingle_set(text):
    ws = [w.lower() for w in words(text)]
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute_components(rows, share=75):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= share * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets}


def test_near_duplicates_of_edge_rows(edge_docs, edge_rows):
    got = minhash.near_duplicates(edge_docs.withColumn("node", F.lit(1)).withColumn("c1", F.lit("x"))).collect()
    want = brute_components([(r[0], r[1]) for r in edge_rows if r[0] is not None])
    assert len(got) == len(edge_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def edited(rng, base, share):
    ws = list(base)
    for _ in range(int(len(ws) * share)):
        ws[rng.randrange(len(ws))] = f"n{rng.randrange(10 ** 6)}"
    return " ".join(ws)


@pytest.mark.parametrize("block", [512, 16])
def test_chains_of_near_copies_keep_every_link(spark, block):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        text = [f"g{g}w{i}" for i in range(150)]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            text = edited(rng, text, rng.choice([0.01, 0.02, 0.05])).split()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows)


def test_keep_and_empty(spark, edge_docs, no_docs):
    kept = minhash.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert 5 in ids and not {6, 7, 8} & set(ids)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_bit_counts_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    x, y = (np.frombuffer(minhash.pack(minhash.minima(np.concatenate([both, o]))), "<u8")[None] for o in (a, b))
    assert abs(minhash.estimates(x, y)[0, 0] - 0.75) < 0.2 and minhash.estimates(x, x)[0, 0] == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (50, 49)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {49: 49, 50: 49}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    from panelcast.llm import minhash
    a, u, v = (" ".join(f"{p}{i}" for i in range(60)) for p in "auv")
    rows = [(3, a), (5, a), (5, u), (7, u), (9, v), (9, v), (2, v + " more"), (11, u.upper()), (12, ""), (12, None), (None, a)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], kind)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.keep(docs).collect()), key=str)
    empty = [r for r in got if r[0] == 12]      # the empty set of an id, once
    assert len(empty) == 1 and sorted(set(got) - set(empty), key=str) == sorted([(3, a), (5, u), (2, v + " more"), (None, a)], key=str)
    unlike = spark.createDataFrame([(5, a, "en", "s", 1), (5, u, "en", "s", 1), (8, u, "en", "s", 1)], kind)
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep(unlike).collect()) == sorted([(5, a), (5, u)])
