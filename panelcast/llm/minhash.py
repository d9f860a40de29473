"""Near-duplicate detection by b-bit MinHash.

A document's set are its distinct shingles of five words.  Signatures keep the
low ``BITS`` bits of 128 minima, packed; 32 bands of four whole minima
make candidates, whose similarity is estimated from the packed
signatures by bit counts, corrected for chance collisions.  Pairs whose
estimate is not far below the threshold are confirmed on the full sets.

Plan.  Equal sets are collapsed to classes first.  In each band's bucket every
class is compared with a leader; confirmed links give components.  Only
buckets that still hold several components are looked at again: there all
pairs across components are estimated in blocks, and those that may be links
are confirmed inside the task unless they are connected by then.  So no pair
list within a group is ever made, and no link that the bands find is lost.  Two sets at
exactly 0.75 share no band with a probability of 6e-6.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  Fewer than five words are
one shingle; null, empty and blank texts have the empty set and no links.
Rows that share an id are rows of their own, each in the component of its own
text; ``keep`` never drops one for what another says.  A row with a null id takes part in no link
(component null, kept).  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import by_key, map_rows, mix64, words, written
from panelcast.llm.components import components
from panelcast.llm.superkmer import text_key, word_hashes

WORDS, SHARE, MINIMA, ROWS, BITS, BLOCK = 5, 75, 128, 4, 4, 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(20240229)
_FACTOR = _DRAWN.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAWN.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
#: chance that two different minima agree in their low bits, and the least estimate
#: that is confirmed: five standard deviations below the threshold
_CHANCE = 2.0 ** -BITS


def least_estimate(share: float = SHARE / 100) -> float:
    agree = share + (1 - share) * _CHANCE
    return share - 5 * float(np.sqrt(agree * (1 - agree) / MINIMA)) / (1 - _CHANCE)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes([w.lower() for w in ws])
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        rolled = h[:len(h) - n + 1] + np.uint64(n)
        for i in range(1, n):
            rolled = rolled * _BASE + h[i:len(h) - n + 1 + i]
    return np.unique(mix64(rolled))


def minima(own: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for lo in range(0, len(own), 2048):
            out = np.minimum(out, (own[lo:lo + 2048, None] * _FACTOR + _SHIFT).min(axis=0))
    return out


def pack(least: np.ndarray) -> bytes:
    """The low bits of the (mixed) minima, 64 / BITS to a word."""
    low = mix64(least) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).astype("<u8").tobytes()


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (rows of words), each left
    row with each right row."""
    agree = np.zeros((len(left), len(right)), np.int64)
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    for w in range(left.shape[1]):
        differ = left[:, w, None] ^ right[None, :, w]
        some = differ.copy()
        for i in range(1, BITS):
            some |= differ >> np.uint64(i)
        agree += 64 // BITS - np.bitwise_count(some & ones).astype(np.int64)
    return (agree / MINIMA - _CHANCE) / (1 - _CHANCE)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    if min(len(a), len(b)) * 100 < share * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, t1, t2, n_shingles, c1, c2, signature, bands); t1 and t2 are hashes of
    the text, c1 and c2 a digest of the set."""
    def run(cols):
        for doc_id, t, t1, t2 in zip(*cols):
            own = shingles(t)
            d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            least = minima(own)
            keys = least.reshape(-1, ROWS)
            with np.errstate(over="ignore"):
                band = np.arange(len(keys), dtype=np.uint64)
                for i in range(ROWS):
                    band = mix64(band * _BASE + keys[:, i])
            yield (doc_id, t1, t2, len(own), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                   pack(least), band.view(np.int64))

    return map_rows(docs.select("doc_id", text, *text_key(text)), run, "doc_id long, t1 long, t2 long, n_shingles long, c1 long, c2 long, signature binary, bands array<long>")


def _apart(name: str):
    """The column under an expression that its table is not dealt by, so that a
    join deals both sides itself and can split a hot key."""
    return F.col(name).bitwiseXOR(F.lit(0)).alias(name)


def _confirm_pairs(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; ``texts`` is (node, text)."""
    def run(cols):
        last, own = None, None
        for a, b, ta, tb in zip(*cols):
            if own is None or a != last[0] or ta != last[1]:
                last, own = (a, ta), shingles(ta)
            if linked(own, shingles(tb), share):
                yield a, b

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    return map_rows(both, run, "a long, b long")


def _block(share: int, floor: float):
    """Task body: all pairs of a block of minority members (side 0) with a
    block of members of the same bucket, across components."""
    def run(_, rows):
        sides, nodes, groups, packed, bands, texts, band = zip(*rows)
        sig = np.frombuffer(b"".join(packed), "<u8").reshape(len(rows), -1)
        keys = np.array([list(b) for b in bands], np.int64)
        nodes, groups = np.array(nodes, np.int64), np.array(groups, np.int64)
        left, right = (np.flatnonzero(np.array(sides) == k) for k in (0, 1))
        if not len(left) or not len(right):
            return []
        sim = estimates(sig[left], sig[right])
        at = np.argwhere((sim >= floor) & (groups[left][:, None] != groups[right][None, :]))
        order = np.argsort(-sim[at[:, 0], at[:, 1]], kind="stable")
        parent: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def own(i):
            if i not in sets:
                sets[i] = shingles(texts[i])
            return sets[i]

        out = []
        for i, j in at[order]:
            i, j = int(left[i]), int(right[j])
            x, y = top(int(groups[i])), top(int(groups[j]))
            if x == y or np.argmax(keys[i] == keys[j]) != band[i]:      # connected, or the first band in common is another
                continue
            if linked(own(i), own(j), share):
                parent[max(x, y)] = min(x, y)
                out.append((int(nodes[i]), int(nodes[j])))
        return out
    return run


def near_duplicates(docs: DataFrame, share: int = SHARE, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links are pairs
    with 100 * intersection >= ``share`` * union."""
    return _found(docs, share, text, block).select("doc_id", "n_shingles", "component_id", "kept")


def _found(docs: DataFrame, share: int, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with the rows' t1, t2, c1, c2 and node."""
    floor = least_estimate(share / 100)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    rows = written(signatures(docs), "signatures")
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        F.first("bands").alias("bands")), "classes")

    each = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(_apart("key"), "size")
    members = written(each.join(crowded.hint("merge"), "key").select("key", "band", "node", "size"), "members")

    # every member with the leader of its bucket, the first by a hash that is
    # the same in all bands, so that a group has few leaders
    leaders = members.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("leader")).select(_apart("key"), "leader")
    pairs = (members.join(leaders.hint("merge"), "key").where("node != leader")
             .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    signed = classes.select(F.col("node"), "signature", "n")
    likely = (pairs.select(_apart("a"), _apart("b"))
              .join(signed.toDF("a", "sa", "na").hint("merge"), "a").join(signed.toDF("b", "sb", "nb").hint("merge"), "b")
              .where(100 * F.least("na", "nb") >= share * F.greatest("na", "nb")))

    def judge(cols):
        if not cols[0]:
            return
        x, y = (np.frombuffer(b"".join(c), "<u8").reshape(len(c), -1) for c in cols[2:])
        for a, b, u, v in zip(cols[0], cols[1], x, y):
            if estimates(u[None], v[None])[0, 0] >= floor:
                yield a, b

    asked = written(map_rows(likely.select("a", "b", "sa", "sb"), judge, "a long, b long"), "pairs")
    nodes = members.where("size > 2").select("node").unionByName(asked.select(F.col("a").alias("node"))).unionByName(
        asked.select(F.col("b").alias("node"))).distinct()
    own = classes.select("node", "c1", "c2").join(nodes.hint("merge"), "node")

    def fetch(cols):
        for node, t, c1, c2 in zip(*cols):
            d = hashlib.blake2b(shingles(t).tobytes(), digest_size=16).digest()
            if (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) == (c1, c2):
                yield node, t

    texts = written(map_rows(docs.withColumnRenamed("doc_id", "node").join(own.hint("merge"), "node")
                             .select("node", "text", "c1", "c2"), fetch, "node long, text string"), "texts")
    links = written(_confirm_pairs(asked, texts, share), "links")
    labels = components(links)

    # buckets that still hold several components
    placed = members.where("size > 2").join(labels.hint("merge"), "node", "left").select(
        "key", "band", "node", F.coalesce("component", "node").alias("group"))
    counts = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("size"))
    mixed = (counts.groupBy("key").agg(F.sum("size").alias("size"), F.max(F.struct("size", "group")).alias("most"))
             .where("most.size < size")
             .select(_apart("key"), F.col("most.group").alias("most"), F.ceil(F.col("size") / block).cast("int").alias("blocks"),
                     F.ceil((F.col("size") - F.col("most.size")) / block).cast("int").alias("minor")))
    split = (placed.join(mixed.hint("merge"), "key")
             .join(classes.select("node", "signature", "bands").hint("merge"), "node").join(texts.hint("merge"), "node"))
    deal = F.xxhash64("node", "key")
    fields = ["node", "group", "signature", "bands", "text", "band"]
    right = split.select("key", F.explode(F.sequence(F.lit(0), F.col("minor") - 1)).alias("i"), F.pmod(deal, "blocks").cast("int").alias("j"),
                         F.lit(1).alias("side"), *fields)
    left = split.where("group != most").select("key", F.pmod(deal, "minor").cast("int").alias("i"),
                                               F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *fields)
    more = written(by_key(left.unionByName(right), ["key", "i", "j"], _block(share, floor), "a long, b long"), "links")
    final = components(links.unionByName(more))

    named = (rows.select("doc_id", "n_shingles", "t1", "t2", "c1", "c2")
             .join(classes.select("c1", "c2", "node").hint("merge"), ["c1", "c2"], "left")
             .join(final.hint("merge"), "node", "left"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", "t1", "t2", "c1", "c2", "node", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest doc_id.  Where that id
    has several texts, the row whose set belongs to the component stays, and each
    unlike one is judged by itself: sets of one smallest id all stay.  Equal rows
    count once.  Rows with null ids stay."""
    found = written(_found(docs, share).where("doc_id is not null").select("doc_id", "t1", "t2", "c1", "c2", "node", "kept"), "found")
    shared = found.where("node is not null").select("node", "c1", "c2").distinct().groupBy("node").count().where("count > 1").select(F.col("node").alias("doc_id"))
    doubtful = found.join(shared.hint("merge"), "doc_id", "left_semi").where("node = doc_id")
    stays = (found.where("kept").unionByName(doubtful).groupBy("doc_id", "c1", "c2")
             .agg(F.min(F.struct("t1", "t2")).alias("t")).select("doc_id", "t.t1", "t.t2"))
    own = docs.withColumns(dict(zip(("__t1", "__t2"), text_key("text"))))
    one = Window.partitionBy("doc_id", "__t1", "__t2").orderBy("doc_id")
    chosen = (own.join(stays.select("doc_id", F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).hint("merge"), ["doc_id", "__t1", "__t2"])
              .withColumn("__row", F.row_number().over(one)).where("__row = 1"))
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))
