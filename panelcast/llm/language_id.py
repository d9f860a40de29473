"""Language identification by Kneser-Ney character language models.

Per language an interpolated Kneser-Ney model over the characters of words:
a word is its lower-cased letters between a start and an end mark, and contexts
stay within the word.  All languages' models lie in the same sorted hash
arrays: one of n-grams with each language's log2 probability, one of contexts
with each language's log2 back-off weight, so that one binary search serves
all languages.  A text gets the language of lowest cross-entropy per symbol.

Rejection is calibrated on sample rows that the models did not see: a text is
rejected if its cross-entropy is above the language's mean by ``slack`` bits
plus ``z`` standard deviations of one word's, shrunk by the root of its words.

The models are fitted on a bounded sample of labelled rows
(``rows_per_lang``); what reaches the driver is the number of rows a language, the sample's distinct
words and the held rows' entropies.  Every text is scored
whole.  Null texts and texts without a letter: language ``und``, score 0,
cross-entropy null, rejected.  Equal scores: the first language in sort order.  Without a
labelled row every text is ``und``.  Rows with a null language are no sample
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import keep_rows, map_rows, mix64
from panelcast.llm.subwords import Memo, sums, vocabulary

ORDER, UND = 5, "und"
START, END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _rolled(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1- to ``order``-grams that begin at each symbol of the
    marked words (valid where ``left`` >= n), each symbol's word, and ``left``,
    the symbols from it to its word's end."""
    joined = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(joined))
    out, rolled = [], np.zeros(len(joined), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            rolled = rolled[:len(joined) - n + 1] * _BASE + joined[n - 1:] + np.uint64(n)
            out.append(mix64(rolled))
    return out, owner, left


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, -1 where it is absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: np.ndarray           # sorted hashes of all n-grams
    logp: np.ndarray            # n-grams x languages, log2
    contexts: np.ndarray        # sorted hashes of all contexts
    back: np.ndarray            # contexts x languages, log2
    unknown: np.ndarray         # log2 probability of a symbol that no n-gram has
    mean: np.ndarray            # calibration, bits per symbol
    spread: np.ndarray
    order: int = ORDER
    slack: float = 0.6
    z: float = 6.0

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) bits of words of letters, and their symbols."""
        if not words or not self.langs:
            return np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        hashes, owner, left = _rolled(words, self.order)
        place = (np.fromiter(map(len, words), np.int64, len(words)) + 2)[owner] - left  # position in the word
        target = np.flatnonzero(place > 0)      # the start mark is given
        total = np.zeros((len(target), len(self.langs)))
        pending = np.arange(len(target))
        for n in range(self.order, 0, -1):
            able = place[target[pending]] >= n - 1
            here = pending[able]
            begin = target[here] - n + 1
            at = _find(self.grams, hashes[n - 1][begin])
            hit = at >= 0
            total[here[hit]] += self.logp[at[hit]]
            miss = here[~hit]
            if n > 1:
                back = _find(self.contexts, hashes[n - 2][target[miss] - n + 1])
                known = back >= 0
                total[miss[known]] += self.back[back[known]]
            else:
                total[miss] += self.unknown
            pending = np.concatenate([pending[~able], miss])
        out = np.stack([np.bincount(owner[target], total[:, k], len(words)) for k in range(len(self.langs))], 1)
        return -out, np.bincount(owner[target], minlength=len(words)).astype(float)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) bits per symbol, symbols and words of each text."""
        memo = self.__dict__.setdefault("_memo", Memo(self.per_word))
        rows, codes, starts = memo.lookup([t.lower() if t else t for t in texts])
        k = len(self.langs)
        total = np.stack([sums(rows[codes, j], starts) for j in range(k + 2)], 1)
        return total[:, :k] / np.maximum(total[:, k], 1)[:, None], total[:, k], total[:, k + 1]

    def per_word(self, known: list[str]) -> np.ndarray:
        """(words x (languages + 2)): bits, symbols, and 1 if it has a letter."""
        plain = [letters(w) for w in known]
        full = np.array([bool(w) for w in plain], bool)
        out = np.zeros((len(known), len(self.langs) + 2))
        if full.any():
            bits, size = self.bits([w for w in plain if w])
            out[full] = np.concatenate([bits, size[:, None], np.ones((len(size), 1))], 1)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits per symbol, rejected) of each text.  The
        score is the language's share of the likelihoods, tempered by the root of the length."""
        out = []
        for bits, n, words in zip(*self.entropies(texts)):
            if not n or not self.langs:
                out.append((UND, 0.0, None, True))
                continue
            best = int(np.argmin(bits))
            share = np.exp2(-(bits - bits[best]) * np.sqrt(n))
            above = bits[best] - self.mean[best] - self.slack - self.z * self.spread[best] / np.sqrt(words)
            out.append((self.langs[best], float(1 / share.sum()), float(bits[best]), bool(above > 0)))
        return out


def _counts(words: list[str], times: np.ndarray, order: int) -> list[dict[str, np.ndarray]]:
    """Per order: sorted n-gram hashes, counts, hashes of context (all but the
    last symbol) and suffix (all but the first).  Lower orders count distinct
    symbols before the n-gram, unless it begins with the start mark."""
    hashes, owner, left = _rolled(words, order)
    size = (np.fromiter(map(len, words), np.int64, len(words)) + 2)[owner]
    first = left == size
    out: list[dict[str, np.ndarray]] = []
    for n in range(1, order + 1):
        valid = left[:len(hashes[n - 1])] >= n
        valid &= ~(first[:len(valid)] & (n == 1))
        begin = np.flatnonzero(valid)
        gram, index, inverse = np.unique(hashes[n - 1][begin], return_index=True, return_inverse=True)
        begin_of = begin[index]
        out.append({"gram": gram, "count": np.bincount(inverse, times[owner[begin]].astype(float), len(gram)),
                    "context": hashes[n - 2][begin_of] if n > 1 else np.zeros(len(gram), np.uint64),
                    "suffix": hashes[n - 2][begin_of + 1] if n > 1 else np.zeros(len(gram), np.uint64),
                    "start": first[begin_of]})
    for n in range(order - 1):
        at = _find(out[n]["gram"], out[n + 1]["suffix"])
        distinct = np.bincount(at[at >= 0], minlength=len(out[n]["gram"])).astype(float)
        out[n]["count"] = np.where(out[n]["start"] | (distinct == 0), out[n]["count"], distinct)
    return out


def train(counts: dict[str, dict[str, int]], held: dict[str, list[str]] | None = None, order: int = ORDER) -> Model:
    """Fit on each language's word counts; ``held`` are texts to calibrate on."""
    langs = tuple(sorted(lang for lang, words in counts.items() if words))
    per = []
    for lang in langs:
        words = sorted(counts[lang])
        per.append(_counts(words, np.array([counts[lang][w] for w in words]), order))
    symbols = len(set().union(*(set(w) for lang in langs for w in counts[lang]))) + 2 if langs else 2
    k = len(langs)
    uniform = np.full(k, 1.0 / symbols)
    grams, probs, contexts, backs = [], [], [], []
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, k))
    unknown = uniform
    for n in range(order):
        merged = {f: np.concatenate([p[n][f] for p in per]) if per else np.zeros(0, np.uint64) for f in ("gram", "context", "suffix")}
        keys, index = np.unique(merged["gram"], return_index=True)
        context_of, suffix_of = merged["context"][index], merged["suffix"][index]
        context_keys = np.unique(context_of)
        ctx = np.searchsorted(context_keys, context_of)
        lower = np.tile(uniform, (len(keys), 1)) if n == 0 else below[np.searchsorted(below_keys, suffix_of)]
        prob, back = np.zeros((len(keys), k)), np.ones((len(context_keys), k))
        for j, p in enumerate(per):
            at = np.searchsorted(keys, p[n]["gram"])
            count = np.zeros(len(keys))
            count[at] = p[n]["count"]
            ones, twos = (p[n]["count"] == 1).sum(), (p[n]["count"] == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.1
            mass = np.bincount(ctx, count, len(context_keys))
            kinds = np.bincount(ctx, count > 0, len(context_keys))
            has = mass > 0
            back[has, j] = discount * kinds[has] / mass[has]
            share = np.where(has[ctx], np.maximum(count - discount, 0) / np.maximum(mass[ctx], 1e-300), 0)
            prob[:, j] = share + back[ctx, j] * lower[:, j]
        if n == 0:
            unknown = back[0] * uniform if len(context_keys) else uniform
        else:
            contexts.append(context_keys)
            backs.append(back)
        grams.append(keys)
        probs.append(prob)
        below_keys, below = keys, prob

    def in_order(keys, values):
        keys, values = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(values) if values else np.zeros((0, k))
        by = np.argsort(keys, kind="stable")
        return keys[by], np.log2(values[by])

    model = Model(langs, *in_order(grams, probs), *in_order(contexts, backs), np.log2(unknown), np.full(k, np.inf), np.zeros(k), order)
    return calibrated(model, [row for lang, texts in (held or {}).items() for row in own_entropies(model, [lang] * len(texts), texts)])


def own_entropies(model: Model, names: list[str], texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    """(language, bits a symbol under its own model, symbols, words) of texts with symbols."""
    bits, n, words = model.entropies(texts)
    at = {lang: j for j, lang in enumerate(model.langs)}
    return [(name, float(bits[i, at[name]]), int(n[i]), int(words[i])) for i, name in enumerate(names) if name in at and n[i]]


def calibrated(model: Model, rows: list[tuple[str, float, int, int]]) -> Model:
    """``model`` with each language's mean cross-entropy, and its spread, over ``own_entropies`` rows."""
    mean, spread = np.full(len(model.langs), np.inf), np.zeros(len(model.langs))
    for j, lang in enumerate(model.langs):
        own = np.array(sorted(r[1:] for r in rows if r[0] == lang), float)
        if len(own):
            mean[j] = np.average(own[:, 0], weights=own[:, 1])
            spread[j] = np.sqrt(np.mean((own[:, 0] - mean[j]) ** 2 * own[:, 2]))
    return dataclasses.replace(model, mean=mean, spread=spread)


def fit(docs: DataFrame, ok: F.Column, lang: str = "lang", rows_per_lang: int = 600, order: int = ORDER) -> Model:
    """Fit on at most ``rows_per_lang`` rows of each language in ``docs``
    (doc_id, text, lang) that ``ok`` admits, chosen by the hash of their id;
    every fifth of them calibrates, scored in tasks."""
    admitted = docs.where(ok & F.col(lang).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(lang).alias("lang"))
    # a hash cut of four times the rows wanted comes first, so that a large language sends few rows to its numbering
    sizes = {r[0]: r[1] for r in admitted.groupBy("lang").count().collect()}
    if not sizes:
        return train({}, None, order)
    cuts = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, 4 * rows_per_lang / n))])
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (admitted.where(F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.lit(1 << 20)) < cuts[F.col("lang")] * (1 << 20))
           .withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= rows_per_lang)
           .groupBy("doc_id", "lang").agg(F.min("at").alias("at")))
    # languages x rows_per_lang ids
    chosen = docs.select("doc_id", "text", F.col(lang).alias("lang")).join(F.broadcast(ids), ["doc_id", "lang"])

    def count(cols):
        tally: dict[tuple, int] = {}
        for name, text, at in zip(cols[1], cols[2], cols[3]):
            if at % 5:
                known, codes, _ = vocabulary([text.lower() if text else text])
                for w, t in zip(known, np.bincount(codes, minlength=len(known)).tolist()):
                    if plain := letters(w):
                        tally[name, plain] = tally.get((name, plain), 0) + t
        return ((a, b, t) for (a, b), t in tally.items())

    counts: dict[str, dict[str, int]] = {}
    got = (map_rows(chosen, count, "lang string, word string, times long")
           .groupBy("lang", "word").agg(F.sum("times").alias("times")))
    for batch in got.toArrow().to_batches():      # much smaller than rows of Python objects
        for name, word, times in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(name, {})[word] = times
    model = train(counts, None, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # bounded by the sample, whatever the data
    held = map_rows(chosen.where("at % 5 = 0").select("lang", "text"), lambda cols: own_entropies(shared.value, *cols),
                    "lang string, bits double, symbols long, words long")
    return calibrated(model, [tuple(r) for r in held.collect()])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # bounded by the sample, whatever the data

    def run(cols):
        return ((i, *p) for i, p in zip(cols[0], shared.value.predict(cols[1])))

    return map_rows(docs.select("doc_id", text), run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts: [not p[3] for p in shared.value.predict(texts)])
