"""Thin queries ``opN_<name>``: each applies its operator, with production
parameters, to the whole of its table and derives the digest columns.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame`` and ``ORACLES`` to
DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to, as digests."""
    import public_tokenizers as public

    from panelcast.llm import bpe_tree
    from panelcast.llm.common import table

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    digits = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    narrow = bpe_tree.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    return narrow.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; learned from rows outside the held-out fold."""
    from panelcast.llm import subwords
    from panelcast.llm.common import fold, table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = subwords.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", fold("doc_id", 5) != 0)
    return subwords.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; learned from rows outside the held-out fold."""
    from panelcast.llm import toxicity
    from panelcast.llm.common import fold, table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", fold("doc_id", 4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned from rows outside the held-out fold."""
    from panelcast.llm import language_id
    from panelcast.llm.common import fold, table

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs, fold("doc_id", 5) != 0)
    return language_id.identify(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits", "rejected")


@register
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 2048 ids."""
    import public_tokenizers as public

    from panelcast.llm import packing
    from panelcast.llm.common import table

    cut = packing.pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public.path("byte_bpe_50k.json"), keep_ids=False,
                         ranks_path=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words that repeated 35-word windows cover."""
    from panelcast.llm import superkmer
    from panelcast.llm.common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    digests = superkmer.kept_texts(docs).select("h1", "h2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return superkmer.attach(docs, digests).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike to 0.75 or more."""
    from panelcast.llm import minhash
    from panelcast.llm.common import table

    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    from panelcast.llm import maxscore
    from panelcast.llm.common import table

    vectors = maxscore.whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", 256.0, "vec_id")
    best = maxscore.top_k(vectors.where("id % 50 = 0"), vectors, 5)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op7_maxscore"] = """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (SELECT vec_id, min(v) AS v FROM fine GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
    FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back from the formatted text."""
    from panelcast.llm import chat
    from panelcast.llm.common import table

    tough = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tough.alias("text"))
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(turns)
    read = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                       F.array_join(chat.masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op4_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)'))
           + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 17 + length(role) END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@register
def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    from panelcast.llm import spotsigs
    from panelcast.llm.common import table

    made = spotsigs.compare_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
    own, edited, after = F.col("own"), F.col("edited_own"), F.col("next_own")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(own).alias("fingerprint"), spotsigs.fingerprint(edited).alias("edited_fingerprint"),
        spotsigs.likeness(own, edited).alias("near_edited"), spotsigs.likeness(own, after).alias("near_next"),
        "next_id", "next_chars")


ORACLES["op5_substring_dedup"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM texts WHERE len(ws) >= 35),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM starts),
twice AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos
         FROM windows JOIN twice USING (win), (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
         FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

ORACLES["op8_minhash"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id,
       coalesce(least(doc_id, b), doc_id) = doc_id AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""


@register
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document towards the benchmark's texts."""
    from panelcast.llm import resampling
    from panelcast.llm.common import table

    drawn = resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


ORACLES["op12_resampling"] = r"""
WITH RECURSIVE texts AS (
    SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
words AS (
    SELECT side, doc_id, row_number() OVER () AS row, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
grams AS (
    SELECT side, row, array_to_string(ws[i:i + k - 1], ' ') AS gram
    FROM (SELECT side, row, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k))),
-- crc32 by half bytes; the sixteen table entries are fixed values of the polynomial
crcs AS (
    SELECT gram, xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, octet_length(encode(gram))), lambda i: [
            instr('0123456789ABCDEF', hex(encode(gram))[2 * i + 2]) - 1, instr('0123456789ABCDEF', hex(encode(gram))[2 * i + 1]) - 1]))),
        lambda c, d: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                                  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, d) & 15)])
        ), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT DISTINCT gram FROM grams)),
hashed AS (SELECT side, row, bucket FROM grams JOIN crcs USING (gram)),
sums AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hashed),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((count(*) FILTER (side = 'b') + 1)::DOUBLE * (any_value(sums.s) + 10000)::DOUBLE
        / ((count(*) FILTER (side = 'd') + 1)::DOUBLE * (any_value(sums.t) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM hashed, sums GROUP BY bucket),
weights AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM hashed JOIN gains USING (bucket) GROUP BY row),
scored AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (
    SELECT doc_id, score, n_features, weight, n_words, CASE WHEN n_words >= 20 THEN
        row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_words, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank FROM ranked
"""


@register
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license notices of every text."""
    from panelcast.llm import licenses
    from panelcast.llm.common import table

    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _licenses_sql() -> str:
    from panelcast.llm.licenses import LINES, PERCENT, PHRASES, TEMPLATES

    def rows(pairs):
        return ", ".join(f"('{a}', '{b}')" for a, b in pairs)

    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
words AS (SELECT row, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
phrases AS (SELECT string_split(phrase, ' ') AS ps, label FROM (VALUES {rows(PHRASES.items())}) AS p(phrase, label)),
places AS (
    SELECT row, label, i - 1 AS start FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM words) w
    JOIN phrases ON ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps),
templates AS (SELECT label, list_distinct(string_split(body, ' ')) AS ts FROM (VALUES {rows(TEMPLATES)}) AS t(label, body)),
lines AS (SELECT row, regexp_split_to_array(low, '[\x0A-\x0D]+') AS ls FROM texts),
blocks AS (
    SELECT row, regexp_extract_all(array_to_string(ls[i:i + {LINES - 1}], ' '), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS bs
    FROM (SELECT row, ls, unnest(range(1, greatest(len(ls) - {LINES - 2}, 2))) AS i FROM lines)),
hits AS (
    SELECT row, label, len(list_intersect(ts, bs)) / len(ts)::DOUBLE AS share
    FROM blocks JOIN templates ON 100 * len(list_intersect(ts, bs)) >= {PERCENT} * len(ts)),
base AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                list_sort(list_distinct(list(label))) AS own FROM places GROUP BY row),
more AS (SELECT row, list(label) AS found, max(share) AS share FROM hits GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN base USING (row) LEFT JOIN more USING (row)
"""


ORACLES["op13_licenses"] = _licenses_sql()


@register
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two or three words."""
    from panelcast.llm import collocations
    from panelcast.llm.common import table

    return collocations.mine(table(spark, sf_dir, "documents", "text", "lang"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS ws
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
grams AS (
    SELECT lang, k, ws[i:i + k - 1] AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
    SELECT c.lang, c.k, c.p, c.a, x.a AS l, y.a AS r, c.cut, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.cut + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
longer AS (SELECT lang, p, a FROM cand WHERE k = 3),
inside AS (SELECT lang, q, max(a) AS a FROM (SELECT lang, p[1:2] AS q, a FROM longer UNION ALL SELECT lang, p[2:3], a FROM longer) GROUP BY lang, q),
stay AS (SELECT w.* FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.q = w.p WHERE w.k = 3 OR i.a IS NULL OR 100 * i.a < 50 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score
    FROM (SELECT *, array_to_string(p, ' ') AS phrase FROM stay)) JOIN n USING (lang)
WHERE rank <= 2000
"""
