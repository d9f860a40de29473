"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words.  The minimiser of a window is the
least hash of its ``mer`` word runs; consecutive windows that share it travel as one packed string, a
super-k-mer, to the bucket of their minimiser, where the windows are sorted and
equal neighbours are repeats.  Every word that a repeated window covers goes.

Plan.  Equal texts are collapsed first (by two 64-bit hashes of the text, with
their number), so that groups of copies cost one text.  A window can repeat
only if its minimiser recurs, so a count of minimisers decides which super-k-mers travel.  Minimisers with
more than ``hot`` super-k-mers, by default a quarter of an even partition's share of all,
are not sent to one bucket: their packed strings are collapsed to distinct ones, whose windows are counted by a
128-bit digest in an aggregation that combines before it shuffles.

Words are ``[^\\x20\\x09-\\x0D]+`` and stay as they are.  Null and empty texts
have no words, lose none and keep the empty text.  Repeated rows are each
others' copies.  Texts shorter than a window lose nothing.  Other columns pass
through; ``n_words``, ``n_removed`` and ``kept`` are replaced if present.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import by_key, map_rows, mix64, partitions, words

WINDOW, MER, CACHED = 35, 5, 400_000
BYTES_EACH = 110     # a super-k-mer begins about every so many bytes of text
_HASHES: dict[bytes, int] = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    known = _HASHES
    if len(known) > CACHED:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    except KeyError:
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def runs(ws: list[bytes], window: int, mer: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """(minimiser, first window, number of windows, whether the minimiser
    recurs in the text) of the super-k-mers."""
    n = len(ws) - window + 1
    if n < 1:
        return [], [], [], []
    h = word_hashes(ws)
    with np.errstate(over="ignore"):
        rolled = h[:len(ws) - mer + 1].copy()
        for i in range(1, mer):
            rolled = rolled * _BASE + h[i:len(ws) - mer + 1 + i]
    mers = least = mix64(rolled)
    span = 1
    across = window - mer + 1
    while 2 * span <= across:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if across > span:
        least = np.minimum(least[:span - across], least[across - span:])
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    keys = least[begin]
    mers = np.sort(mers[mers <= keys.max()])
    recurs = np.searchsorted(mers, keys, "right") - np.searchsorted(mers, keys) > 1
    return keys.view(np.int64).tolist(), begin.tolist(), np.diff(np.append(begin, n)).tolist(), recurs.tolist()


def spans(at: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges that windows beginning at the sorted ``at`` cover, merged."""
    out: list[list[int]] = []
    for i in at:
        if out and i <= out[-1][1]:
            out[-1][1] = i + window
        else:
            out.append([i, i + window])
    return [(a, b) for a, b in out]


def repeated(group: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each (packed words, times) the windows in it that occur more than
    once in all the group, by sorting the windows."""
    found = []
    for row, (packed, times) in enumerate(group):
        ws = packed.split(b" ")
        found += [(b" ".join(ws[i:i + window]), row, i, times) for i in range(len(ws) - window + 1)]
    found.sort()
    out: list[list[int]] = [[] for _ in group]
    for _, same in groupby(found, key=lambda f: f[0]):
        same = list(same)
        if len(same) > 1 or same[0][3] > 1:
            for _, row, i, _ in same:
                out[row].append(i)
    return [sorted(x) for x in out]


def _bucket(window: int):
    """Task body for the super-k-mers of one minimiser."""
    def run(_, rows):
        marks = repeated([(r[0], r[4]) for r in rows], window)
        return [(r[1], r[2], r[3] + a, r[3] + b) for r, at in zip(rows, marks) for a, b in spans(at, window)]
    return run


def covered(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (h1, h2, text, copies) and the word ranges (h1, h2,
    lo, hi) in them that repeated windows cover."""
    texts = (docs.select(*text_key("text"), F.col("text").cast("binary").alias("text")).groupBy("h1", "h2")
             .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))

    fair = F.lit(hot) if hot is not None else docs.agg(F.greatest(
        F.lit(64), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (BYTES_EACH * 4 * partitions(docs.sparkSession))).alias("fair")).scalar()

    def narrow(cols):
        for h1, h2, text, copies in zip(*cols):
            for key, start, _, recurs in zip(*runs(words(text), window, mer)):
                yield key, h1, h2, start, 2 if copies > 1 or recurs else 1

    every = map_rows(texts, narrow, "key long, h1 long, h2 long, start int, times int")
    shared = (every.groupBy("key").agg(F.sum("times").alias("total")).where("total > 1")
              .select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "total"))
    wanted = (every.join(shared.hint("merge"), "key").select("h1", "h2", "start", (F.col("total") > fair).alias("many"))
              .groupBy("h1", "h2").agg(F.collect_list(F.when(~F.col("many"), F.col("start"))).alias("cold"),
                                       F.collect_list(F.when(F.col("many"), F.col("start"))).alias("hot")))

    def packed(cols):
        for h1, h2, text, copies, chosen in zip(*cols):
            ws, chosen = words(text), set(chosen)
            for key, start, size, _ in zip(*runs(ws, window, mer)):
                if start in chosen:
                    yield key, b" ".join(ws[start:start + size + window - 1]), h1, h2, start, 2 if copies > 1 else 1

    def travelling(kind):
        some = wanted.where(F.size(kind) > 0).select("h1", "h2", kind)
        return map_rows(texts.join(some.hint("merge"), ["h1", "h2"]), packed,
                        "key long, packed binary, h1 long, h2 long, start int, times int")

    cold = by_key(travelling("cold"), ["key"], _bucket(window), "h1 long, h2 long, lo int, hi int")

    # shared by very many: distinct strings, their windows' digests, counts
    many = travelling("hot").withColumns({"p1": F.xxhash64("packed"), "p2": F.xxhash64(F.lit(1), "packed")})
    strings = many.groupBy("p1", "p2").agg(F.first("packed").alias("packed"), F.sum("times").alias("times"))

    def digests(cols):
        for p1, p2, text, times in zip(*cols):
            ws = text.split(b" ")
            for i in range(len(ws) - window + 1):
                d = hashlib.blake2b(b" ".join(ws[i:i + window]), digest_size=16).digest()
                yield int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), p1, p2, i, times

    each = map_rows(strings, digests, "d1 long, d2 long, p1 long, p2 long, at int, times long")
    twice = (each.groupBy("d1", "d2").agg(F.sum("times").alias("total")).where("total > 1")
             .select(F.col("d1").bitwiseXOR(F.lit(0)).alias("d1"), F.col("d2").bitwiseXOR(F.lit(0)).alias("d2")))
    marks = (each.join(twice.hint("merge"), ["d1", "d2"]).groupBy("p1", "p2").agg(F.collect_list("at").alias("at"))
             .select(F.col("p1").bitwiseXOR(F.lit(0)).alias("p1"), F.col("p2").bitwiseXOR(F.lit(0)).alias("p2"), "at"))
    placed = (many.select("p1", "p2", "h1", "h2", "start").join(marks.hint("merge"), ["p1", "p2"])
              .select("h1", "h2", F.explode("at").alias("at"), "start")
              .select("h1", "h2", (F.col("start") + F.col("at")).alias("lo"), (F.col("start") + F.col("at") + window).cast("int").alias("hi")))
    return texts, cold.unionByName(placed)


def text_key(column: str) -> tuple[F.Column, F.Column]:
    """Two 64-bit hashes of a text; null and empty texts count as equal."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def kept_texts(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int | None = None, verbatim: bool = False) -> DataFrame:
    """(h1, h2, n_words, n_removed, kept) of every distinct text: the words
    that stay, joined by one blank, as UTF-8; with ``verbatim`` a text that
    loses nothing stays as it is."""
    texts, ranges = covered(docs, window, mer, hot)
    per_text = ranges.groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def cut(cols):
        for h1, h2, text, ranges in zip(*cols):
            ws = words(text)
            gone = np.zeros(len(ws) + 1, np.int64)
            for r in ranges or []:
                gone[r["lo"]] += 1
                gone[r["hi"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            kept = [w for w, s in zip(ws, stays.tolist()) if s] if ranges else ws
            whole = verbatim and text is not None and len(kept) == len(ws)
            yield h1, h2, len(ws), len(ws) - len(kept), text if whole else b" ".join(kept)

    joined = texts.select("h1", "h2", "text").join(per_text.hint("merge"), ["h1", "h2"], "left")
    return map_rows(joined, cut, "h1 long, h2 long, n_words long, n_removed long, kept binary")


def attach(docs: DataFrame, per_text: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` (without the text) with their distinct text's columns."""
    own = docs.drop(*[c for c in per_text.columns]).withColumns(dict(zip(("h1", "h2"), text_key(text)))).drop(text)
    return own.join(per_text.hint("merge"), ["h1", "h2"]).drop("h1", "h2")


def deduplicate(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and its text cut to the words that
    stay, joined by one blank; texts that lose nothing stay as they are (null: empty)."""
    done = kept_texts(docs, window, mer, hot, verbatim=True).withColumn("__text", F.col("kept").cast("string")).drop("kept")
    return attach(docs, done).withColumnRenamed("__text", "text")
