"""Byte-level BPE as a monoid over byte strings.

A text's pieces (matches of the tokenizer's pattern) are encoded one by one.
Within a piece the bytes are halved recursively; leaves are merged directly,
and two neighbouring encodings are joined by re-encoding a window around the
seam, which doubles until the tokens outside provably stay: a token sequence
is the encoding of its bytes exactly if every adjacent pair is the encoding of
the pair's own bytes, so a window is settled once the pairs at both its edges
are.  Decoding concatenates token bytes up the same kind of tree.

Null text: encoded as the empty text (no ids, empty bytes).  Ids beyond the
vocabulary raise ``KeyError``.  Null id lists decode to empty bytes.  Very long texts
are encoded whole, piece by piece.  Repeated rows are rows of their own; an empty table gives no rows.  Extra
columns pass through; the output columns are named by parameters.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelcast.llm.common import ROWS
from panelcast.session import ship_package

LEAF = 16            # bytes that are merged directly
FAN = 64             # tokens of a leaf of the decoding tree
CACHED = 400_000     # entries of each of a worker's memories
_NONE = 1 << 40
_RUN = re.compile(r"\s\s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBPE:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import regex
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.bytes_of = {v: k for k, v in ranks.items()}
        # the pattern's \s is the Unicode property, without the control characters that Python counts in
        white = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.findall = regex.compile(white).findall
        self._leaves: dict[bytes, list[int]] = {}
        self._windows: dict[tuple[int, ...], list[int]] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    # -- encoding ---------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Direct encoding: merge the adjacent pair of lowest rank, leftmost
        first, until none is in the table; O(n log n) by a heap."""
        n, ranks = len(data), self.ranks
        if n < 2:
            return [ranks[data]] if n else []
        if n <= 64:
            get = ranks.get
            parts = [data[i:i + 1] for i in range(n)]
            pairs = [get(data[i:i + 2], _NONE) for i in range(n - 1)]
            while pairs and (best := min(pairs)) != _NONE:
                at = pairs.index(best)
                parts[at] += parts[at + 1]
                del parts[at + 1], pairs[at]
                if at:
                    pairs[at - 1] = get(parts[at - 1] + parts[at], _NONE)
                if at < len(pairs):
                    pairs[at] = get(parts[at] + parts[at + 1], _NONE)
            return [ranks[p] for p in parts]
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], nxt[i] = 1, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(data[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = nxt[i]
        return out

    def window(self, tokens: tuple[int, ...]) -> list[int]:
        """Encoding of the joined bytes of a few tokens, remembered."""
        got = self._windows.get(tokens)
        if got is None:
            got = self.merge(b"".join(map(self.bytes_of.__getitem__, tokens)))
            if len(tokens) <= 4:
                if len(self._windows) > CACHED:
                    self._windows.clear()
                self._windows[tokens] = got
        return got

    def settled(self, a: int, b: int) -> bool:
        """True if the two tokens are the encoding of their joined bytes."""
        got = self.window((a, b))
        return len(got) == 2 and got[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left or right
        k = 1
        while True:
            window = self.window((*left[-k:], *right[:k]))
            left_ok = k >= len(left) or self.settled(left[-k - 1], window[0])
            right_ok = k >= len(right) or self.settled(window[-1], right[k])
            if left_ok and right_ok:
                return left[:max(0, len(left) - k)] + window + right[k:]
            k *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= self.leaf:
            got = self._leaves.get(data)
            if got is None:
                if len(self._leaves) > CACHED:
                    self._leaves.clear()
                got = self._leaves[data] = self.merge(data)
            return got
        return self.join(self.encode_bytes(data[:n // 2]), self.encode_bytes(data[n // 2:]))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch that begins and ends at piece boundaries, as 32-bit integers."""
        got = self._old.get(chunk)
        if got is None:
            got = array("i", [i for p in self.findall(chunk) for i in self.encode_bytes(p.encode("utf-8", "replace"))]).tobytes()
        if len(chunk) < 64:
            if len(self._new) >= CACHED:
                self._old, self._new = self._new, {}
            self._new[chunk] = got
        return got

    def encode_flat(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers.  A lone blank between other characters always opens
        a new piece, so texts without runs of white space are looked up in
        chunks that begin at their blanks."""
        if not text:
            return b""
        chunk = self._chunk
        if text[0].isspace() or text[-1].isspace() or _RUN.search(text):
            return b"".join([self._new.get(p) or chunk(p) for p in self.findall(text)])
        first, *rest = text.split(" ")
        out = [chunk(first)]
        for word in rest:
            own = " " + word
            out.append(self._new.get(own) or chunk(own))     # the memory changes when it is full
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_flat(text)).tolist()

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[int] | None, fan: int = FAN) -> bytes:
        """Bytes of ids: blocks of ``fan`` tokens, concatenated pairwise up the tree."""
        if not ids:
            return b""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i:i + fan])) for i in range(0, len(ids), fan)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
        return level[0]


_LOADED: dict[tuple[str, str], TreeBPE] = {}


def tree_bpe(path: str, pattern: str) -> TreeBPE:
    """The worker's encoder for a rank file, loaded once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TreeBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def _with_column(df: DataFrame, source: str, out: str, kind: T.DataType, arrow: pa.DataType, fn) -> DataFrame:
    ship_package(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    at = df.columns.index(source)
    keep = [i for i, c in enumerate(df.columns) if c != out]

    def run(batches):
        apply = fn()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = pa.array([apply(x) for x in part.column(at).to_pylist()], type=arrow)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [made],
                                                 names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>); a column of that name is replaced."""
    return _with_column(df, text, ids, T.ArrayType(T.IntegerType(), False), pa.list_(pa.field("element", pa.int32(), False)),
                        lambda: tree_bpe(ranks_path, pattern).encode)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary), the bytes of ``ids``."""
    return _with_column(df, ids, out, T.BinaryType(), pa.binary(), lambda: tree_bpe(ranks_path, pattern).decode)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` without its text, with ``ids`` and the bytes ``out`` that they decode to, in one
    pass: the ids of a batch are one flat buffer from the encoder to Spark."""
    ship_package(df.sparkSession)
    element = pa.list_(pa.field("element", pa.int32(), False))
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, ids, out)] + [
        T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(out, T.BinaryType())])
    at, keep = df.columns.index(text), [i for i, c in enumerate(df.columns) if c not in (text, ids, out)]

    def run(batches):
        tree = tree_bpe(ranks_path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                flat = [tree.encode_flat(x) for x in part.column(at).to_pylist()]
                offsets = np.cumsum([0, *[len(f) // 4 for f in flat]], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)), type=element)
                back = pa.array([tree.decode(array("i", f).tolist()) for f in flat], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [made, back],
                                                 names=[batch.schema.names[i] for i in keep] + [ids, out])

    return df.mapInArrow(run, schema)
