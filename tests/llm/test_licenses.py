"""License scan against a plain rendering in Python, and its plan."""

import re

from panelcast.llm import licenses
from panelcast.llm.queries import ORACLES, QUERIES
from tools.compare import duck

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(doc_id, text, percent=licenses.PERCENT, lines=licenses.LINES):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    ws = re.findall(WORD, low)
    places, own, found, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        ps = phrase.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(ps)] == ps]
        places += at
        own |= {label} if at else set()
    rows = re.split(r"[\x0A-\x0D]+", low)
    for i in range(max(1, len(rows) - lines + 1)):
        block = set(re.findall(WORD, " ".join(rows[i:i + lines])))
        for label, body in licenses.TEMPLATES:
            want = set(body.split())
            if 100 * len(want & block) >= percent * len(want):
                found.add(label)
                score = max(score, len(want & block) / len(want))
    return (doc_id, len(ws), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(own)), ",".join(sorted(own | found)), 1.0 if places else score)


HARD = [
    "cc by cc by, CC-BY", "all rights reserved all rights\nreserved", "Kelvin cc by: K İ", "general public\x00license",
    "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files",
    "Permission is hereby granted, free of charge, to any\n\nperson obtaining a copy of this software\nand\nassociated\ndocumentation files",
    "released under the license of mit", "released under mit license", "gnu general public license", "Gnu LESSER general public license\r\n",
    "this work is licensed under the gnu general public license version 2", "éall rights reserved", "\nall\n\nrights\n\nreserved\n\n",
    "all " * 3000 + "rights reserved", "x\n" * 2000 + "Licensed under CC BY-NC 4.0", "subject to terms of the mozilla public license",
]


def test_equals_brute_force(spark, edge_rows):
    rows = [r[:2] for r in edge_rows] + [(100 + i, t) for i, t in enumerate(HARD)] + [(100, HARD[0]), (100, HARD[1])]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, labels string, line int")
    got = sorted((tuple(r) for r in licenses.scan(docs).select(COLUMNS).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)


def test_other_thresholds_keep_every_match(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for percent, lines in ((60, 1), (75, 2), (100, 4)):
        got = sorted((tuple(r) for r in licenses.scan(docs, percent=percent, lines=lines).select(COLUMNS).collect()), key=str)
        assert got == sorted((brute(i, t, percent, lines) for i, t in enumerate(HARD)), key=str)


def test_empty_table(spark, no_docs):
    assert licenses.scan(no_docs).collect() == []


def test_plan_runs_no_python(spark):
    plan = QUERIES["op13_licenses"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_equals_sql(spark):
    got = sorted((tuple(r) for r in QUERIES["op13_licenses"](spark, SF).select(COLUMNS).collect()), key=str)
    res = duck(SF).execute(ORACLES["op13_licenses"])
    at = [[d[0] for d in res.description].index(k) for k in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str)
