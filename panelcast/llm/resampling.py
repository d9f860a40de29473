"""Importance resampling towards a target distribution of hashed n-grams.

Each text is lower-cased (A-Z only) and its separators collapse to single
blanks.  One overlapped regex scan with look-arounds at the word boundaries
then gives, at every word, the spans of the runs of one to ``LONGEST`` words
that begin there; the crc32 of a span's bytes modulo ``buckets`` is its
feature.  A bucket's gain is its log ratio between the target texts and all
source texts; a document's weight is the sum over its features.  Drawing
the highest weights plus Gumbel noise of the document's own id is sampling without
replacement in proportion to exp(weight / 1000).

Every text is scanned once: its sorted features are written as byte-packed
differences, from which tasks count buckets (an array of fixed size each) and
then sum gains.  The driver and the broadcast hold ``buckets`` numbers only.

Null, empty and wordless texts have no features and weight 0, and are never
drawn below ``least`` words.  Very long texts are scanned whole.  Ties go to the smaller
id, null ids last (they are hashed as an empty id); repeated rows are rows of their own.
An empty target leaves gains that depend on the source alone; an empty source
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import map_rows, ship_package, written
from panelcast.operators.rank import global_rank

BUCKETS, LONGEST = 10_000, 3
_LETTERS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
# groups: the first word, then each further word with the blank before it
_SPANS = regex.compile(rb"(?<![^ ])([^ ]++)" + rb"(?:( [^ ]++)" * (LONGEST - 1) + rb")?" * (LONGEST - 1) + rb"(?![^ ])")


def collapsed(text: bytes | None) -> bytes:
    """The text's words, lower-cased, joined by single blanks."""
    return b" ".join((text or b"").translate(_LETTERS).split())


def features(line: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted buckets of all runs of one to ``LONGEST`` words of a collapsed text."""
    crc, out = zlib.crc32, []
    add = out.append
    for match in _SPANS.finditer(line, overlapped=True):
        code = 0
        for piece in match.groups():
            if piece is None:
                break
            code = crc(piece, code)     # the crc of a longer span goes on from the shorter one's
            add(code)
    found = np.array(out, np.uint32) % np.uint32(buckets)
    return np.sort(found.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")


def scan(docs: DataFrame, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, features): differences of the sorted features, as bytes."""
    def run(cols):
        for one, body in zip(*cols):
            line = collapsed(body)
            found = features(line, buckets)
            yield one, line.count(b" ") + 1 if line else 0, len(found), np.diff(found, prepend=found.dtype.type(0)).tobytes()

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, F.col(text).cast("binary")), run, f"{key} {kind}, n_words long, n_features long, features binary")


def _unpacked(packed: bytes, buckets: int) -> np.ndarray:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    return np.cumsum(np.frombuffer(packed, kind), dtype=np.int64)


def counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows: each task adds up one array of ``buckets`` counts."""
    ship_package(scanned.sparkSession)
    arrow = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(_unpacked(packed.as_py(), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=arrow)

    return scanned.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln) of the smoothed target share over the source
    share; the driver gets ``buckets`` rows, whatever the data."""
    spark = source.sparkSession
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .fillna(0, ["s", "t"]))
    got = both.select("bucket", "s", "t").toArrow().sort_by("bucket")
    s, t = (got.column(k).to_numpy() for k in ("s", "t"))
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s.tolist(), t.tolist()))], "bucket int, s double, t double")
    ratio = ((F.col("t") + 1) * F.lit(float(s.sum() + buckets))) / ((F.col("s") + 1) * F.lit(float(t.sum() + buckets)))
    return rows.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain")).toArrow().sort_by("bucket").column("gain").to_numpy()


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """``scanned`` without its features, with their summed gains as ``weight``."""
    shared = scanned.sparkSession.sparkContext.broadcast(gain)      # one number a bucket
    rest = [k for k in scanned.columns if k != "features"]

    def run(cols):
        for *own, packed in zip(*cols):
            yield *own, int(shared.value[_unpacked(packed, len(shared.value))].sum())

    kinds = ", ".join(f"{k} {scanned.schema[k].dataType.simpleString()}" for k in rest)
    return map_rows(scanned.select(*rest, "features"), run, f"{kinds}, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of ``seed:key``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.log(-F.log(u)) * -1000.0)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42,
             buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``;
    ``rank`` is null but for the ``percent`` of the rows of ``least`` words or
    more that are drawn, 1 for the highest score."""
    scanned = written(scan(docs, buckets, text, key), "features")
    aims = target.select(F.lit(0).alias(key), F.col(text))
    gain = gains(counts(scanned, buckets), counts(scan(aims, buckets, text, key), buckets), buckets)
    scored = written(weigh(scanned, gain).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "scores")
    long = scored.where(F.col("n_words") >= least)
    drawn = (long.count() * percent) // 100
    ranked = global_rank(long, "score", [key]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)
