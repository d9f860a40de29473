"""Chat formatting and fingerprints: SQL functions only."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelcast.llm import chat, spotsigs
from panelcast.llm.queries import QUERIES

TOUGH = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", " ", "\n", "<", "[", "x", "é😀", "[\\INST]", "<\\\\s>", "$1"]


def test_any_turns_come_back(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "", "to\nol", "\\n</s>", "[INST]"])
            text = "".join(rng.choices(TOUGH, k=rng.randrange(6)))
            rows.append((c, t, role, text))
            want.setdefault(c, []).append((role, text))
    rng.shuffle(rows)
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1)))
    for r in made.withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect():
        own = want[r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == own and r["n_turns"] == len(own)
        assert r["loss"] == [t for role, t in own if role == "assistant"]
        spans = [r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(spans) == len(r["loss"])


def test_null_tied_and_empty_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "user", None), (1, 1, "user", None), (1, None, None, "a"), (None, 0, "assistant", "b"), (None, 0, "assistant", "a"), (2, 0, "assistant", "y" * 50_000)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert got[1]["formatted"] == "<<SYS>>\na\n<</SYS>>" + "<s>[INST]  [/INST]" * 2 and got[1]["loss_spans"] == []
    assert got[None]["formatted"] == " a </s> b </s>" and got[2]["n_turns"] == 1
    assert chat.format_conversations(spark.createDataFrame([], kind)).count() == 0


def test_hard_conversation_is_escaped(spark):
    got = QUERIES["op4_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(text)
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_native_plans_run_no_python(spark):
    for name in ("op4_chat_format", "op6_spotsigs"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def edits(rows):
    rows = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    return rows


def test_edited_texts_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op6_spotsigs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after, q = docs[(k + 1) % len(docs)][1], len(text) // 4
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[:len(text) - q] + after[:q]).encode()).hexdigest()
    apart = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > 0.3 for r in apart) > 0.9 * len(apart) and sum(r["near_next"] < 0.2 for r in apart) > 0.9 * len(apart)


def test_fingerprints_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    made = spotsigs.compare_with_edits(edge_docs.withColumn("h", F.lit(1)).withColumn("own", F.lit(2)))
    rows = made.select("doc_id", "n_chars", spotsigs.fingerprint(F.col("own")).alias("f"), spotsigs.likeness(F.col("own"), F.col("own")).alias("same"),
                       spotsigs.likeness(F.col("own"), F.col("edited_own")).alias("near")).collect()
    assert len(rows) == len(edge_rows)
    assert all(r["same"] == 1 and 0 <= r["near"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["f"])
    assert by[0] == by[1] == by[2] == {""} and by[5] == by[6] == by[7] and len(by[5]) == 1
    assert spotsigs.compare_with_edits(no_docs).count() == 0
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    assert spotsigs.compare_with_edits(one).first()["edited"] == "abcdefab"


@pytest.mark.parametrize("text,want", [
    ("the quick brown fox", 1), ("The QUICK, brown! fox", 1), ("the of quick and brown", 1), ("quick brown", 1), ("quick brown fox", 2), ("the end", 1),
    ("fox", 1), (" . ", 0), (None, 0)])
def test_chains(spark, text, want):
    own = spotsigs.with_spots(spark.createDataFrame([(text,)], "t string"), "t", "s").select("s").first()[0]
    assert len(own) == want


def test_anchors_between_content_words_are_skipped(spark):
    a, b = [r[0] for r in spotsigs.with_spots(spark.createDataFrame([("the quick brown fox",), ("the quick of the brown fox",)], "t string"), "t", "s").select("s").collect()]
    assert a[0] in b


def test_equal_short_texts_with_anchors_are_alike(spark):
    short = ["the quick brown fox", "the cat and the dog sat on a mat", "quick brown fox", "the", "fox"]
    made = spotsigs.with_spots(spark.createDataFrame([(t, "the quick brown dog") for t in short], "t string, u string"), "t", "s")
    made = spotsigs.with_spots(made, "u", "v").select("t", spotsigs.likeness(F.col("s"), F.col("s")).alias("same"),
                                                      spotsigs.likeness(F.col("s"), F.col("v")).alias("other"))
    got = {r["t"]: r for r in made.collect()}
    assert {t: got[t]["same"] for t in short} == dict.fromkeys(short, 1.0)
    # the chain quick-brown in both; without an anchor the pairs quick-brown and brown-fox
    assert got["the quick brown fox"]["other"] == 1 and got["quick brown fox"]["other"] == 1 / 2


def brute_spots(text):
    text = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").lower() if c not in spotsigs.MARKS)
    words, anchors = [w for w in text.split(" ") if w], set(spotsigs.ANCHORS.split())
    found = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1:] if x not in anchors][:2]
        if w in anchors and len(after) == 2:
            found.add(tuple(after))
    return found or ({(words[0],)} if len(words) == 1 else set(zip(words, words[1:])))


def test_likeness_against_sets(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "der", *(f"w{k}" for k in range(12))]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 20, 200]))) for _ in range(120)]
    # 7 against 8 signatures, and sets whose lengths lie far apart
    texts += [" ".join(f"the a{k} b{k}" for k in range(n)) for n in (7, 8, 1, 200)]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 8)] + [(texts[-4], texts[-3]), (texts[-2], texts[-1])]
    df = spotsigs.with_spots(spotsigs.with_spots(spark.createDataFrame(pairs, "t string, u string"), "t", "a"), "u", "b")
    for r in df.select("t", "u", spotsigs.likeness(F.col("a"), F.col("b")).alias("x"), spotsigs.likeness(F.col("a"), F.col("b"), 0.75).alias("y")).collect():
        a, b = brute_spots(r["t"]), brute_spots(r["u"])
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert r["x"] == want and (r["y"] == want or (r["y"] == 0 and want < 0.75))
    assert brute_spots(texts[-4]) < brute_spots(texts[-3])
