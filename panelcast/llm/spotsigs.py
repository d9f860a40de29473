"""Document fingerprints by spot signatures, in SQL functions only.

Text is lower-cased, ASCII white space becomes blanks and ASCII punctuation goes.  At each anchor, a common word, the chain of the next two content
words (words that are no anchors) is a signature.  A text without any such chain takes the pairs of
neighbouring words instead (a lone word is a pair by itself), hashed alike, so that every text has one kind of set.
A fingerprint is the sorted distinct signature hashes in hexadecimal.

Fingerprints are compared by Jaccard similarity.  Sets are partitioned by length on a
logarithmic scale: a search that only wants similarities from ``least`` on does not intersect
sets whose partitions rule it out.  The default, 0, gives the similarity of every pair.

Null and empty texts have the empty fingerprint; two empty ones are alike (1), an
empty and another not (0).  Equal texts have equal fingerprints.  Rows of one
id and equal text count once in the order of documents; rows with null ids
come first.  Texts are processed whole, however long.  Ties cannot arise, as order is by id and
text hash.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import partitions, written

# Common words of English, French, German and Spanish.
ANCHORS = """
the of and to a in is it that was for with on by be as are this an from at or
de la le et les des en un du que une pour est qui dans pas par sur au avec ou
der die und den von zu das mit sich im auf für nicht ist dem ein als eine
el y los se del las por con no una su para es al lo
"""
BLANKS, MARKS = "\t\n\x0b\x0c\r", "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def _anchors() -> str:
    """Pattern of an anchor; the look-ahead turns long words away at once."""
    words = sorted(set(ANCHORS.split()), key=lambda w: (-len(w), w))
    return rf"(?=[^ ]{{1,{len(words[0])}}} )(?:{'|'.join(words)})"


def with_spots(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the array column ``name``, the text's sorted signatures.  Steps that are used more than once are columns, so
    that they are evaluated once, and not for every element of an array."""
    some = _anchors()
    skip = rf"(?:{some} +)*+"
    chain = rf" {some}(?= +{skip}([^ ]+ +{skip}[^ ]+) )"
    letters = F.trim(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), BLANKS + MARKS, " " * len(BLANKS)))
    chains = F.regexp_extract_all(F.concat(F.lit(" "), "__plain", F.lit(" ")), F.lit(chain), F.lit(1))
    # anchors may stand between a chain's two words
    own = F.transform(chains, lambda c: F.xxhash64(F.substring_index(c, " ", 1), F.substring_index(c, " ", -1)))
    words = F.col("__words")
    pairs = (F.when(F.size(words) == 0, F.array().cast("array<bigint>"))
             .when(F.size(words) == 1, F.array(F.xxhash64(words[0])))
             .otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)))))
    return (df.withColumn("__plain", letters)
            .withColumn("__own", F.sort_array(F.array_distinct(own)))
            .withColumn("__words", F.when(F.size("__own") == 0, F.filter(F.split("__plain", " "), lambda w: w != "")))
            .withColumn(name, F.when(words.isNull(), F.col("__own")).otherwise(F.sort_array(F.array_distinct(pairs))))
            .drop("__plain", "__own", "__words"))


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def length_partition(size: Column) -> Column:
    """Sizes up to 1, 2, 4, ... : sets k partitions apart are at most 2 ** (1 - k) alike."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; with ``least`` above 0, pairs whose lengths rule
    that similarity out count as 0."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    alike = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
    if least > 0:
        apart = F.abs(length_partition(F.size(a)) - length_partition(F.size(b)))
        alike = alike.when(apart > 1 - math.floor(math.log2(least)), 0.0)
    return alike.otherwise(both / F.when(total > 0, total))


def _order(docs: DataFrame) -> DataFrame:
    """(doc_id, h, before) of every document: ``before`` (doc_id, h, n_chars) comes before it
    in ascending order, and the last before the first.  Only these columns are sorted; the ends of
    the sorted partitions are put together in a table with a row for each partition."""
    spark = docs.sparkSession
    keys = docs.groupBy("doc_id", "h").agg(F.max("n_chars").alias("n_chars"))
    row = F.struct("doc_id", "h", "n_chars")
    sorted_keys = written(keys.repartitionByRange(partitions(spark), "doc_id", "h").select(F.spark_partition_id().alias("part"), row.alias("row")), "order")
    ends = sorted_keys.groupBy("part").agg(F.max("row").alias("end"))
    ends = ends.select("part", F.coalesce(F.lag("end").over(Window.orderBy("part")),
                                          F.last("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    inner = sorted_keys.withColumn("inner", F.lag("row").over(Window.partitionBy("part").orderBy("row")))
    return inner.join(F.broadcast(ends), "part").select("row.doc_id", "row.h", F.coalesce("inner", "end").alias("before"))


def compare_with_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_chars, edited (text), the sets of the
    text, of the edited text and of the next document, as ``own``, ``edited_own`` and ``next_own``,
    and the next document's id and length.  Both uses of the joined rows have the same columns, so that
    Spark shuffles the texts once."""
    plain = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    plain = plain.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    # joins need keys without nulls
    key = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("h").alias("k3")]
    before = _order(plain.select("doc_id", "h", "n_chars")).select(*key, "before")
    sets = with_spots(plain, "text", "own").select(*key, "doc_id", "n_chars", "text", "own")
    each = sets.join(before.hint("merge"), ["k1", "k2", "k3"])
    b = F.col("before")
    heads = each.select(F.coalesce(b["doc_id"], F.lit(0)).alias("k1"), b["doc_id"].isNull().alias("k2"), b["h"].alias("k3"),
                        F.left("text", F.floor(b["n_chars"] / 4).cast("int")).alias("head"), F.col("own").alias("next_own"),
                        F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"))
    # repeated rows would meet each of their copies' heads
    heads = heads.dropDuplicates(["k1", "k2", "k3"])
    both = each.join(heads.hint("merge"), ["k1", "k2", "k3"])
    edited = both.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), "head"))
    return with_spots(edited, "edited", "edited_own").select(
        "doc_id", "n_chars", "next_id", "next_chars", "edited", "own", "edited_own", "next_own")
