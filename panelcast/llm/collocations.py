"""Phrase mining by direct-address tiles of frequency-ranked ids.

Texts are lower-cased (A-Z only) and cut into pieces at punctuation and line ends;
words are what stands between blanks.  Counts are kept per language.

1. Tasks cut texts into stretches of about ``TOKENS`` words of one language, each
   written as its distinct words and their local codes (0 ends a piece).
2. Words that occur ``least`` times or more get ids by falling frequency.  Rarer words
   end phrases like punctuation: no phrase that holds one can be frequent.
3. A pair of neighbouring ids falls into a tile of the id plane.  Tiles are ``HEAD`` ids wide at
   the frequent end and then double, so that all hold a like share of the text and
   their number hardly grows with it.  Within a stretch, and again where stretches meet,
   well-filled tiles are counted by a dense ``bincount`` and the others as sorted (code, count) lists.
4. Pairs with ``least`` occurrences are ranked by frequency in turn: their ids go
   back, tile by tile, to the stretches that hold them, where (pair id, next word id) is
   counted in tiles in the same way, which gives the phrases of three words.

A tile is dealt as ``strips`` code ranges, so more partitions mean smaller shares; a
task holds one stretch, or the distinct codes of one strip, at a time.
Nothing is collected and no dictionary is broadcast.  Ranks are numbered
over range partitions, so that a language with most of the rows is dealt like the others.

Null and empty texts have no words.  A null language is ``und``.  Very long texts are
several stretches, cut at piece ends.  Repeated rows count again.  Ties in rank
go by count and phrase; an empty table gives no rows.  Other columns are ignored.
Scores are exact for counts up to 10^15; the ids of a pair may take 62 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import partitions, ship_package, written

TOKENS, STRETCH = 1 << 21, 1 << 22       # words a stretch, bytes of text looked at together
HEAD, CELLS, DENSE = 64, 1 << 22, 16     # first tile side; most cells of a dense strip, and cells per occurrence
CUT = b"\xff"                            # stands in no UTF-8 text
_LETTERS = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Codes(dict):
    """Words numbered as they come; piece ends are 0."""

    def __init__(self):
        super().__init__({CUT: 0})

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def stretches_of(text: bytes) -> Iterator[list[bytes]]:
    """The text's words and piece ends, in portions that end at a piece's end."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(CUT, at + STRETCH) + 1 or len(text)
        yield text[at:end].replace(CUT, b" \xff ").split()
        at = end


def stretches(docs: DataFrame, text: str = "text", lang: str = "lang", tokens: int = TOKENS) -> DataFrame:
    """(batch, lang, words, counts, n, codes): the corpus in stretches of about ``tokens`` words."""
    ship_package(docs.sparkSession)
    arrow = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("codes", pa.binary())])

    def flush(open_):
        rows = []
        for name, (known, parts) in open_.items():
            codes = np.concatenate(parts)
            counts = np.bincount(codes, minlength=len(known))[1:]
            rows.append((name, list(known)[1:], counts, int(counts.sum()), codes.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = {}, 0
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                for ws in stretches_of(body.as_py()):
                    known, parts = open_.setdefault(name.as_py(), (Codes(), []))
                    parts.append(np.fromiter((*map(known.__getitem__, ws), 0), np.int32, len(ws) + 1))
                    held += len(ws)
                    if held >= tokens:
                        yield flush(open_)
                        open_, held = {}, 0
        if open_:
            yield flush(open_)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    cut = rows.where("length(text) > 0").mapInArrow(run, "lang string, words array<binary>, counts array<long>, n long, codes binary")
    return cut.withColumn("batch", F.monotonically_increasing_id())


def ranked(df: DataFrame, order: Sequence[Column], name: str, what: str) -> DataFrame:
    """``df``, written, with ``name``: 0, 1, ... in ``order`` within each lang.  Rows are
    numbered in range partitions; a table of one row a partition and language holds the offsets."""
    keys = [F.col("lang").asc(), *order]
    sorted_ = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    made = written(sorted_.withColumn("__at", F.monotonically_increasing_id()), what).withColumn("__part", F.shiftright("__at", 33))
    sizes = made.groupBy("lang", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    before = F.sum("__n").over(Window.partitionBy("lang").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("lang", "__part", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__offset"))
    return made.join(offsets, ["lang", "__part"]).withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def band(ids: np.ndarray) -> np.ndarray:
    """0 for the first ``HEAD`` ids, then one band a doubling."""
    return np.maximum(np.frexp(np.asarray(ids, np.float64))[1] - HEAD.bit_length() + 1, 0).astype(np.int64)


def start(bands: np.ndarray) -> np.ndarray:
    return np.where(np.asarray(bands) > 0, np.int64(HEAD) << np.maximum(np.asarray(bands, np.int64) - 1, 0), 0)


def width(bands: np.ndarray) -> np.ndarray:
    return np.int64(HEAD) << np.maximum(np.asarray(bands, np.int64) - 1, 0)


def step(i: np.ndarray, j: np.ndarray, strips: int) -> np.ndarray:
    """Cells of a strip of a tile."""
    return -(-(width(i) * width(j)) // strips)


def code_type(i: int, j: int) -> type:
    return np.uint32 if int(width(i)) * int(width(j)) <= 1 << 32 else np.int64


def unplace(i: int, j: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code // width(j) + start(i), code % width(j) + start(j)


def groups(left: np.ndarray, right: np.ndarray, strips: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(tile row, tile column, strip, positions, codes in the tile) of id pairs, strip by strip."""
    i, j = band(left), band(right)
    code = (left - start(i)) * width(j) + right - start(j)
    s = code // step(i, j, strips)
    key = (i * 64 + j) * strips + s
    # numpy sorts 16-bit keys in linear time
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
        at = order[lo:hi]
        yield int(i[at[0]]), int(j[at[0]]), int(s[at[0]]), at, code[at]


def tally(left: np.ndarray, right: np.ndarray, strips: int) -> list[tuple]:
    """(row, column, strip, codes, counts) of id pairs: well-filled strips by dense counts, the others sorted."""
    out = []
    for i, j, s, _, code in groups(left, right, strips):
        cells = int(step(i, j, strips))
        if cells <= CELLS and len(code) * DENSE >= cells:
            n = np.bincount(code - s * cells)
            used = np.flatnonzero(n)
            out.append((i, j, s, used + s * cells, n[used]))
        else:
            out.append((i, j, s, *np.unique(code, return_counts=True)))
    return out


CHUNK = "lang string, i long, j long, s long, batch long, codes binary, counts binary"
_CHUNK = pa.schema([("lang", pa.string()), *[(k, pa.int64()) for k in ("i", "j", "s", "batch")], ("codes", pa.binary()), ("counts", pa.binary())])


def chunk_rows(lang: str, batch: int, tallied: list[tuple]) -> pa.RecordBatch:
    i, j, s, codes, counts = zip(*tallied)
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.int64()), pa.array([batch] * len(i), pa.int64()),
        pa.array([c.astype(code_type(a, b)).tobytes() for a, b, c in zip(i, j, codes)], pa.binary()),
        pa.array([c.astype(np.int64).tobytes() for c in counts], pa.binary())], schema=_CHUNK)


class Strip:
    """Counts of one strip: sorted lists, or a dense array once it is filled well enough."""

    def __init__(self, i: int, j: int, s: int, strips: int):
        self.cells = int(step(i, j, strips))
        self.low, self.parts, self.held, self.limit, self.dense = s * self.cells, [], 0, 1 << 18, None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        if self.dense is not None:
            self.dense[codes.astype(np.int64) - self.low] += counts     # codes of one chunk are distinct
            return
        self.parts.append((codes.astype(np.int64), counts.copy()))      # not the Arrow batch they lie in
        self.held += len(codes)
        if self.cells <= CELLS and self.held * DENSE >= self.cells:
            self.dense, parts, self.parts = np.zeros(self.cells, np.int64), self.parts, []
            for c, n in parts:
                self.dense[c - self.low] += n
        elif self.held > self.limit:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
            self.limit = max(self.limit, 2 * self.held)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[cuts], np.add.reduceat(counts, cuts)

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            used = np.flatnonzero(self.dense >= least)
            return used + self.low, self.dense[used]
        codes, total = self.merged()
        return codes[total >= least], total[total >= least]


def dealt(df: DataFrame, *also: str) -> DataFrame:
    keys = ["lang", "i", "j", "s"]
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *also)


def frequent(chunks: DataFrame, least: int, strips: int) -> DataFrame:
    """(lang, left, right, a) of the id pairs that occur ``least`` times or more in all chunks."""
    arrow = pa.schema([("lang", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])

    def done(key, tile):
        codes, n = tile.frequent(least)
        left, right = unplace(key[1], key[2], codes)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(n), pa.string()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(n)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for row, own in enumerate(zip(*columns)):
                if own != key:
                    if tile is not None:
                        yield done(key, tile)
                    key, tile = own, Strip(*own[1:], strips)
                tile.add(np.frombuffer(batch.column(4)[row].as_buffer(), code_type(*own[1:3])), np.frombuffer(batch.column(5)[row].as_buffer(), np.int64))
        if tile is not None:
            yield done(key, tile)

    return dealt(chunks.drop("batch")).mapInArrow(run, "lang string, left long, right long, a long")


def encoded(cut: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(batch, lang, ids): the stretches as word ids, -1 for piece ends and words outside the vocabulary."""
    ship_package(cut.sparkSession)
    local = cut.select("batch", "lang", F.posexplode("words").alias("code", "word"))
    ids = local.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("batch").agg(F.collect_list(F.struct("code", "id")).alias("ids"))
    arrow = pa.schema([("batch", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = np.frombuffer(batch.column(2)[row].as_buffer(), np.int32)
                known = batch.column(3)[row].values
                ids = np.full(int(codes.max()) + 1, -1, np.int64)
                ids[known.field("code").to_numpy() + 1] = known.field("id").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([ids[codes].tobytes()], pa.binary())], schema=arrow)

    return cut.select("batch", "lang", "codes").join(ids, "batch").mapInArrow(run, "batch long, lang string, ids binary")


def pair_chunks(streams: DataFrame, strips: int) -> DataFrame:
    """Tile counts of neighbouring words, stretch by stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[row].as_buffer(), np.int64)
                both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                if found := tally(ids[:-1][both], ids[1:][both], strips):
                    yield chunk_rows(batch.column(1)[row].as_py(), batch.column(0)[row].as_py(), found)

    return streams.mapInArrow(run, CHUNK)


def pair_ids(chunks: DataFrame, pairs: DataFrame, strips: int) -> DataFrame:
    """(batch, i, j, codes, ids): for each chunk the ids of its pairs that are in ``pairs`` (lang, left, right, id)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            left, right, ids = (batch.column(k).to_numpy() for k in (1, 2, 3))
            for lang in sorted(set(langs)):
                at = np.flatnonzero(langs == lang)
                yield chunk_rows(lang, -1, [(i, j, s, code, ids[at[own]]) for i, j, s, own, code in groups(left[at], right[at], strips)])

    arrow = pa.schema([("batch", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, table = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            out = []
            for row, (*own, number) in enumerate(zip(*columns)):
                if own != key:
                    key, parts, table = own, [], None
                codes = np.frombuffer(batch.column(5)[row].as_buffer(), code_type(*own[1:3]))
                if number < 0:      # the strip's pairs come first
                    parts.append((codes.copy(), np.frombuffer(batch.column(6)[row].as_buffer(), np.int64).copy()))
                    continue
                if table is None and parts:
                    codes_, ids = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
                    order = np.argsort(codes_)
                    table, parts = (codes_[order], ids[order]), []
                if table is not None:
                    at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
                    hit = table[0][at] == codes
                    if hit.any():
                        out.append((number, key[1], key[2], codes[hit].tobytes(), table[1][at[hit]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    known = pairs.select("lang", "left", "right", "id").mapInArrow(pack, CHUNK)
    return dealt(known.unionByName(chunks), "batch").mapInArrow(answer, "batch long, i long, j long, codes binary, ids binary")


def triple_chunks(streams: DataFrame, answers: DataFrame, strips: int) -> DataFrame:
    """Tile counts of (frequent pair, next word), where the next word's pair is frequent as well."""
    none = {k: F.lit(None).cast(t).alias(k) for k, t in (("lang", "string"), ("ids", "binary"), ("i", "long"), ("j", "long"), ("codes", "binary"))}
    rows = streams.select("batch", F.lit(1).alias("last"), "lang", none["i"], none["j"], none["codes"], "ids").unionByName(
        answers.select("batch", F.lit(0).alias("last"), none["lang"], "i", "j", "codes", "ids"))

    def triples(words, parts):
        own, at = np.unique(words, return_inverse=True)
        left, right, ids = (np.concatenate(x) for x in zip(*parts))
        key = np.searchsorted(own, left) * len(own) + np.searchsorted(own, right)
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        both = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
        want = at[both] * len(own) + at[both + 1]
        where = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[where] == want
        pair = np.full(len(words), -1, np.int64)
        pair[both[hit]] = ids[where[hit]]
        both = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
        return tally(pair[both], words[both + 2], strips)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for row, (own, last, lang, i, j) in enumerate(zip(*columns)):
                if own != number:
                    number, parts = own, []
                ids = np.frombuffer(batch.column(6)[row].as_buffer(), np.int64)
                if not last:
                    left, right = unplace(i, j, np.frombuffer(batch.column(5)[row].as_buffer(), code_type(i, j)).astype(np.int64))
                    parts.append((left, right, ids.copy()))
                elif parts and (found := triples(ids, parts)):
                    yield chunk_rows(lang, own, found)

    spark = streams.sparkSession
    return rows.repartition(partitions(spark), "batch").sortWithinPartitions("batch", "last").mapInArrow(run, CHUNK)


def ratio(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits."""
    a, l, r = (f"cast({x} as decimal(38,0))" for x in (a, l, r))
    return F.expr(f"(cast(1000000 as decimal(38,0)) * {a} * {a}) div ({l} * {r})")


def mine(docs: DataFrame, least: int = 10, best: int = 2000, absorb: int = 50, text: str = "text", lang: str = "lang",
         tokens: int = TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of
    two or three words with ``least`` occurrences or more, without those that lie inside a
    longer one with at least ``absorb`` percent of their occurrences."""
    strips = -(-partitions(docs.sparkSession) // 32)
    cut = written(stretches(docs, text, lang, tokens), "stretches")
    counted = (cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word"))
               .agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least))
    words = ranked(counted, [F.col("f").desc(), F.col("word").asc()], "id", "vocabulary")
    streams = written(encoded(cut, words), "streams")
    chunks = written(pair_chunks(streams, strips), "pairs")
    pairs = ranked(frequent(chunks, least, strips), [F.col("a").desc(), F.col("left").asc(), F.col("right").asc()], "id", "frequent-pairs")
    triples = written(frequent(triple_chunks(streams, pair_ids(chunks, pairs, strips), strips), least, strips), "triples")

    def named(side):
        return words.select("lang", F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("f").alias(f"{side}_f"))

    two = written(pairs.join(named("left"), ["lang", "left"]).join(named("right"), ["lang", "right"]), "two")
    head = two.select("lang", F.col("id").alias("left"), F.col("left_word").alias("w1"), F.col("right_word").alias("w2"),
                      F.col("right").alias("middle"), F.col("left_f").alias("f1"), F.col("a").alias("f12"))
    tail = two.select("lang", F.col("left").alias("middle"), "right", F.col("right_word").alias("w3"), F.col("right_f").alias("f3"),
                      F.col("a").alias("f23"), F.col("id").alias("tail_id"))
    three = written(triples.join(head, ["lang", "left"]).join(tail, ["lang", "middle", "right"]), "three")
    inside = (three.select("lang", F.col("left").alias("id"), F.col("a").alias("longer"))
              .unionByName(three.select("lang", F.col("tail_id").alias("id"), F.col("a").alias("longer")))
              .groupBy("lang", "id").agg(F.max("longer").alias("longer")))
    blank = F.lit(b" ")
    short = (two.join(inside, ["lang", "id"], "left").where(f"longer is null or 100 * longer < {int(absorb)} * a")
             .select("lang", F.concat("left_word", blank, "right_word").alias("phrase"), "a", F.col("left_f").alias("l"), F.col("right_f").alias("r"),
                     ratio("a", "left_f", "right_f").alias("score")))
    cuts = three.withColumns({"s1": ratio("a", "f1", "f23"), "s2": ratio("a", "f12", "f3")})
    first = F.col("s1") <= F.col("s2")
    long = cuts.select("lang", F.concat("w1", blank, "w2", blank, "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    top = ranked(short.unionByName(long), order, "rank", "phrases").where(F.col("rank") < best)
    total = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(total, "lang").select("lang", (F.col("rank") + 1).alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
