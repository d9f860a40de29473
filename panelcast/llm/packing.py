"""Best-fit packing by sums of squares.

Documents become token ids with an end id; ids beyond the capacity are cut, so
that all pieces but a document's first are full.  A task packs the pieces of
one shard, longest first: of the open sequences that a piece fits, it goes
where the squared counts of open sequences per residual gap become smallest
(ties: the smallest gap), and a new sequence is opened where none fits.
Sequences that stay emptier than ``tolerance`` are taken apart, and the pieces of all
shards' such sequences are packed in a next round, until a round is one shard or
saves less than ``worth`` of the sequences that it began with; one that saves none is not used.
Shards are dealt by row and hold about ``per_shard`` pieces at any input size.

Null and empty texts are a document of the end id alone.  Repeated documents
and null ids are packed row by row.  Without rows there are no pieces.  Extra
columns are ignored by ``pieces`` and passed through by ``pack``, where columns
named ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import map_rows, written
from panelcast.session import ship_package

CAPACITY, PER_SHARD, CACHED = 2048, 4096, 700_000
_RUN = re.compile(r"\s\s")


class Ids:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizer in
    ``path`` gives them without adding special tokens.

    Texts that hold the string of an added token, such as <|endoftext|>, are encoded whole
    by that tokenizer, which gives the string the token's id.  In all others, a lone blank between other characters always opens a new token, so texts
    without runs of white space are looked up in chunks that begin at their
    blanks, and only chunks that are new to the worker are encoded.  With ``ranks_path``, a file of
    the same vocabulary as ranks, tiktoken encodes those, which gives the same ids in less time.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(path)
        self.encode_whole = lambda texts: (e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False))
        added = [re.escape(t.content) for t in whole.get_added_tokens_decoder().values()]
        self.holds_added = re.compile("|".join(added)).search if added else lambda text: None
        if ranks_path:
            import tiktoken

            from panelcast.llm.bpe_tree import load_ranks
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
            self.encode_all = lambda texts: map(own.encode_ordinary, texts)
        else:
            self.encode_all = self.encode_whole
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokenize(self, texts: list[str], whole: bool = False) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in (self.encode_whole if whole else self.encode_all)(texts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts."""
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old, absent, parts = self.new, self.old, {}, []
        for text in texts:
            text = text or ""
            if self.holds_added(text):
                parts.append(self.tokenize([text], whole=True)[0])
                continue
            if not text or text[0].isspace() or text[-1].isspace() or _RUN.search(text):
                parts.append(text)
                continue
            chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _chunks(text)
            got = list(map(new.get, chunks))
            if None in got:
                for i, own in enumerate(got):
                    if own is None:
                        chunk = chunks[i]
                        if chunk in old:
                            new[chunk] = got[i] = old[chunk]
                        else:
                            absent[chunk] = None
                            got[i] = chunk
            parts.append(got)
        absent = list(absent)
        new.update(zip(absent, self.tokenize(absent)))
        out = []
        for part in parts:
            if isinstance(part, bytes):
                out.append(part)
            elif isinstance(part, str):
                out.append(self.tokenize([part])[0])
            else:
                out.append(b"".join([new[x] if isinstance(x, str) else x for x in part] if absent else part))
        return out


def _chunks(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + word for word in rest)]


_LOADED: dict[tuple, Ids] = {}


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be short."""
    first = (total - 1) % capacity + 1 if total else 0
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, total, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = True,
           text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if kept, ids) of every row.
    ``ranks_path`` and ``pattern``: see ``Ids``."""
    end = np.array([end_id], "<u4").tobytes()
    which = (tokenizer_path, ranks_path, pattern)

    def run(cols):
        if which not in _LOADED:
            _LOADED[which] = Ids(*which)
        for doc_id, ids in zip(cols[0], _LOADED[which].encode(cols[1])):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start:4 * (start + length)]
                row = (doc_id, k, start, length, zlib.crc32(own))
                yield (*row, np.frombuffer(own, "<u4")) if keep_ids else row

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return map_rows(docs.select("doc_id", text), run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each length in the given order, and each
    sequence's gap at the end."""
    counts = np.zeros(capacity + 1, np.int64)       # open sequences per gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        held = counts[s:capacity]                   # gaps s, s + 1, ...
        # what the sum changes by when a sequence goes from gap g to g - s
        change = 2 * (counts[:max(0, capacity - s)] - held) + 2
        if len(held):
            change[0] = 1 - 2 * held[0]             # filled sequences count for no gap
            change[held == 0] = np.iinfo(np.int64).max
        k = int(change.argmin()) if len(held) else -1
        if k >= 0 and held[k]:
            gap = k + s
            at = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, at = capacity, len(gaps)
            gaps.append(capacity)
        sequence[i], offset[i] = at, capacity - gap
        gaps[at] = gap - s
        if gap > s:
            counts[gap - s] += 1
            open_at[gap - s].append(at)
    return sequence, offset, np.array(gaps, np.int64)


def _pack_shard(capacity: int, tolerance: float, top: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="__shard").sort_values("length", ascending=False, kind="stable", ignore_index=True)
        sequence, offset, gaps = sum_of_squares(part["length"].to_numpy(), capacity)
        part["sequence_id"] = top + (int(key[0]) << 24) + sequence
        part["offset"] = offset
        part["__poor"] = gaps[sequence] > tolerance * capacity
        return part

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD, tolerance: float = 0.01,
         worth: float = 0.01) -> DataFrame:
    """``pieces`` (a table with a column ``length`` of 1 to ``capacity``) with
    columns sequence_id and offset.  Its rows should be cheap to read again."""
    ship_package(pieces.sparkSession)
    plain = pieces.drop("sequence_id", "offset")
    todo = written(plain, "pieces")
    schema = T.StructType([*plain.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("__poor", T.BooleanType())])
    done, level, count = [], 0, todo.count()
    kept, held = None, None             # the poor sequences of the round before, and how many
    while True:
        shards = max(1, -(-count // per_shard))
        row = F.monotonically_increasing_id()       # of a written table, so it stays
        dealt = todo.withColumn("__shard", F.pmod(F.xxhash64(row, F.lit(level)), F.lit(shards)))
        packed = written(dealt.groupBy("__shard").applyInPandas(_pack_shard(capacity, tolerance, level << 56), schema), f"packed{level}")
        sizes = packed.groupBy("sequence_id").agg(F.first("__poor").alias("poor"), F.count(F.lit(1)).alias("n")).agg(
            F.count(F.lit(1)).alias("all"), F.count_if("poor").alias("poor"), F.sum(F.when(F.col("poor"), F.col("n"))).alias("pieces")).first()
        if held is not None and sizes["all"] >= held:
            done.append(kept)
            break
        if shards == 1 or not sizes["poor"] or (held is not None and sizes["all"] > (1 - worth) * held):
            done.append(packed.drop("__poor"))
            break
        done.append(packed.where(~F.col("__poor")).drop("__poor"))
        kept, held = packed.where("__poor").drop("__poor"), sizes["poor"]
        todo, level, count = kept.drop("sequence_id", "offset"), level + 1, sizes["pieces"]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
