"""Importance resampling against a plain rendering in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

from panelcast.llm import resampling
from panelcast.llm.queries import ORACLES, QUERIES
from tools.compare import duck

SF = "/root/testdata/sf0.001"


def grams(text):
    lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return ws, [zlib.crc32(" ".join(ws[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, target, percent, least):
    own = [(i, *grams(t)) for i, t in docs]
    s = Counter(b for _, _, g in own for b in g)
    t = Counter(b for x in target for b in grams(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, ws, g in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(long[:len(long) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_edges_equal_brute_force(spark, edge_docs, edge_rows):
    target = ["w1 w2 w3", None, "", edge_rows[5][1][:200]]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    got = resampling.resample(edge_docs.withColumnRenamed("lang", "score"), frame, percent=50)
    want = brute([r[:2] for r in edge_rows], target, 50, 20)
    rows = sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str)
    # equal rows share their ranks between them
    assert [r[:5] for r in rows] == [r[:5] for r in want] and sorted(r[5] or 0 for r in rows) == sorted(r[5] or 0 for r in want)
    assert {r[0]: r[5] for r in rows if r[0] != 5} == {r[0]: r[5] for r in want if r[0] != 5}


def test_empty_tables(spark, no_docs, edge_docs):
    assert resampling.resample(no_docs, no_docs).count() == 0
    assert resampling.resample(edge_docs, no_docs).where("rank is not null").count() == 0      # fewer than 20 documents qualify


def test_scan_overlaps_spans():
    line = resampling.collapsed("A b,,\tC  ß9_d".encode())
    assert line == "a b c ß9 d".encode()
    want = sorted(zlib.crc32(g.encode()) % 10_000 for g in ("a", "b", "c", "ß9", "d", "a b", "b c", "c ß9", "ß9 d", "a b c", "b c ß9", "c ß9 d"))
    assert resampling.features(line).tolist() == want


def test_query_equals_sql(spark):
    got = sorted((tuple(r) for r in QUERIES["op12_resampling"](spark, SF).select(COLUMNS).collect()), key=str)
    res = duck(SF).execute(ORACLES["op12_resampling"])
    at = [[d[0] for d in res.description].index(k) for k in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str)
