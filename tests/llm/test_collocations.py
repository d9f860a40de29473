"""Phrase mining against a plain rendering in Python, and its tiles against counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from panelcast.llm import collocations as co
from panelcast.llm.queries import ORACLES, QUERIES
from tools.compare import duck

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, best, absorb):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(a for p, a in own.items() if len(p) == 1)
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= absorb * a for q, b in own.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            cuts = [(10 ** 6 * a * a // (own[p[:k]] * own[p[k:]]), own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, l, r = min(cuts, key=lambda c: c[0])
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "x\x1cy", "A", "a", "日本", "it's"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(120):
        ws = rng.choices(words, weight, k=rng.randrange(0, 200))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "! "]) for w in ws)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return [*rows, ("en", "same " * 300), ("en", None), ("de", ""), ("de", " \t.,"), ("de", None), rows[0], rows[0], (None, "same, same; " * 30)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, id int, word string")
    want = brute(rows, 10, 2000, 50)
    assert len(want) > 50 and any(len(p[2].split(" ")) == 3 for p in want)
    for tokens in (100, 1 << 20):
        assert sorted((tuple(r) for r in co.mine(docs, tokens=tokens).select(COLUMNS).collect()), key=str) == want


def test_best_and_many_strips(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "70")       # three strips a tile
        got = co.mine(docs, least=4, best=25, absorb=80, tokens=500).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 25, 80)


def test_long_text_is_cut_at_piece_ends(monkeypatch):
    monkeypatch.setattr(co, "STRETCH", 50)
    text = ("one Two three, four five " * 40 + "six" * 100 + ". seven").encode()
    parts = list(co.stretches_of(text))
    assert len(parts) > 5 and all(p[-1] == co.CUT for p in parts[:-1])
    monkeypatch.setattr(co, "STRETCH", 1 << 22)
    assert sum(parts, []) == next(co.stretches_of(text))


def test_empty_tables(spark, no_docs, edge_docs):
    assert co.mine(no_docs).count() == 0
    assert co.mine(edge_docs.limit(2)).count() == 0


def test_tiles_count_like_a_counter():
    rng = np.random.default_rng(7)
    for strips in (1, 3, 64):
        left = np.minimum(rng.zipf(1.3, 60_000), 10 ** 9) - 1
        right = np.minimum(rng.zipf(1.2, 60_000), 10 ** 7) - 1
        want = Counter(zip(left.tolist(), right.tolist()))
        got, tiles = {}, {}
        for part in np.array_split(np.arange(len(left)), 5):
            for i, j, s, codes, counts in co.tally(left[part], right[part], strips):
                tiles.setdefault((i, j, s), co.Strip(i, j, s, strips)).add(codes.astype(co.code_type(i, j)), counts)
        assert any(t.dense is not None for t in tiles.values()) and any(t.dense is None for t in tiles.values())
        for (i, j, _), tile in tiles.items():
            codes, n = tile.frequent(1)
            got |= dict(zip(zip(*(x.tolist() for x in co.unplace(i, j, codes))), n.tolist()))
        assert got == want


def test_query_equals_sql(spark):
    got = sorted((tuple(r) for r in QUERIES["op11_collocations"](spark, SF).select(COLUMNS).collect()), key=str)
    assert got and got == sorted(duck(SF).execute(ORACLES["op11_collocations"]).fetchall(), key=str)
