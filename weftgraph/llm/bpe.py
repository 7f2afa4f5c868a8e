"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into parts where no pattern match can cross (before a space between
two non-spaces), and each part falls into pattern matches. As in the library, a
match that is a token as a whole is that token. Every other match is halved down to
single bytes, and the encodings of halves are joined up the tree: a window around
their boundary is encoded anew, and doubles on the side that has not settled. It
has settled when the window's outer token and its neighbour outside form a
*compatible pair*, one that encodes to itself. A sequence whose neighbours are all
compatible is the encoding of its bytes: the first merge across a token boundary
would also happen in the pair alone. So the join is exact, associative, and
independent of where a match was halved. The parts of a document are joined up a
tree too; there the join is concatenation, as no token crosses a match.

Decoding concatenates token bytes up a balanced tree.

Encodings of matches, halves and windows are remembered in caches of bounded size
that forget what was not asked for lately; results do not depend on them.

Null text encodes like the empty text: no ids, no bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import checked_broadcast, map_arrow, pick

CHUNK_CHARS = 1 << 15
CACHE_ENTRIES = 120_000
SCHEMA = "doc_id bigint, ids_le32 binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tree_fold(parts: Sequence, join: Callable, empty):
    """Reduce neighbours pairwise until one is left; join must be associative."""
    level = list(parts)
    while len(level) > 1:
        paired = [join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) & ~1 :]
    return level[0] if level else empty


class Recent(dict):
    """Results of a function, made when they are asked for.

    When it is full, what it holds becomes the older half, from which entries come
    back when they are asked for; what is not is forgotten with the next change.
    """

    def __init__(self, make: Callable, most: int = CACHE_ENTRIES):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        """Hold nothing any more, the function included, so that no cycle goes through it."""
        self.make = self.older = None
        self.clear()


class BpeCodec:
    """Encoder and decoder for one table of ranks and one split pattern.

    leaf_bytes is where halving ends: at single bytes, unless a test asks otherwise.
    joins and windows count the joins and those that encoded a window anew.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = 1, entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        self.leaf_bytes = max(1, leaf_bytes)
        self.tokens = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.joins = self.windows = 0
        self.match = Recent(self._match, 2 * entries)
        self.half = Recent(self._half, entries)
        self.window = Recent(self._window, entries)
        top = max(self.tokens, default=0) + 1
        sizes = np.array([len(self.tokens.get(i, b"")) for i in range(top)], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.text = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(17)]

    def close(self) -> None:
        """Free the caches at once: they refer to the codec, and a cycle stays until it is collected."""
        for cache in (self.match, self.half, self.window):
            cache.forget()

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Plain merging of a short byte string: lowest rank first, leftmost on ties."""
        rank, worst = self.ranks.get, len(self.ranks) + 1
        at = list(range(len(data) + 1))  # where parts begin
        cost = [rank(data[i : i + 2], worst) for i in at[:-2]]
        while cost:
            best = min(cost)
            if best == worst:
                break
            i = cost.index(best)
            del at[i + 1], cost[i]
            if i < len(cost):
                cost[i] = rank(data[at[i] : at[i + 2]], worst)
            if i:
                cost[i - 1] = rank(data[at[i - 1] : at[i + 1]], worst)
        return tuple([self.ranks[data[i:j]] for i, j in zip(at, at[1:])])

    def _window(self, window: tuple[int, ...]) -> tuple[int, ...]:
        return self.merge(b"".join([self.tokens[t] for t in window]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbouring byte strings from their encodings."""
        self.joins += 1
        if not left or not right:
            return left + right
        window, known = left[-1:] + right[:1], self.window
        middle = known[window]
        if middle == window:  # a compatible pair: nothing changes
            return left + right
        n, m = len(left), len(right)
        i = j = 1
        while True:
            self.windows += 1
            settled_left = i >= n or known[pair := (left[-i - 1], middle[0])] == pair
            settled_right = j >= m or known[pair := (middle[-1], right[j])] == pair
            if settled_left and settled_right:
                return left[: n - i] + middle + right[j:]
            i, j = (i if settled_left else min(2 * i, n)), (j if settled_right else min(2 * j, m))
            middle = known[left[n - i :] + right[:j]]

    def halves(self, data: bytes) -> tuple[int, ...]:
        """A byte string by halves, down to single bytes; short halves are remembered."""
        return self.half[data] if len(data) <= 12 else self._half(data)

    def _half(self, data: bytes) -> tuple[int, ...]:
        size = len(data)
        if size <= self.leaf_bytes:
            return self.merge(data)
        middle = size // 2
        if size <= 24:  # both halves are short
            return self.join(self.half[data[:middle]], self.half[data[middle:]])
        return self.join(self.halves(data[:middle]), self.halves(data[middle:]))

    def _match(self, text: str) -> bytes:
        """One match, as the bytes of its ids."""
        data = text.encode()
        known = self.ranks.get(data)
        ids = self._half(data) if known is None else (known,)
        return self.packs[len(ids)](*ids) if len(ids) <= 16 else np.array(ids, "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) > 1000 and len(max(found, key=len)) > 64:  # long matches are not remembered
            return b"".join([self.match[m] if len(m) <= 64 else self._match(m) for m in found])
        return b"".join(map(self.match.__getitem__, found))

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        return np.frombuffer(tree_fold([self._part(c) for c in safe_chunks(text or "")], bytes.__add__, b""), "<u4")

    def decode(self, ids: Sequence[int], leaf: int = 1 << 14) -> bytes:
        """The bytes of a sequence of ids."""
        ids = np.asarray(ids, np.int64)

        def tokens(some: np.ndarray) -> bytes:
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            return self.text[np.arange(int(ends[-1])) + np.repeat(self.starts[some] - ends + sizes, sizes)].tobytes()

        return tree_fold([tokens(ids[i : i + leaf]) for i in range(0, len(ids), leaf)], bytes.__add__, b"")


_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Cut a text into parts whose pattern matches are those of the whole.

    A space between two non-spaces always starts a match: no match reaches from
    a non-space over a space, and a run of one space goes with what follows.
    """
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while len(text) - start > size:
        cut_at = _SAFE.search(text, start + size)
        if cut_at is None:
            break
        out.append(text[start : cut_at.start()])
        start = cut_at.start()
    return [*out, text[start:]]


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", entries: int = CACHE_ENTRIES) -> DataFrame:
    """Encode every text whole and decode the ids again.

    Returns doc_id, ids_le32 (ids as little-endian unsigned 32-bit integers) and
    decoded (bytes), one row for each input row, repeated rows included. Null and
    empty texts give empty binaries. An empty table gives an empty table. Columns
    besides the id and the text are not read. entries bounds the caches of a task:
    fewer take less memory and more time, and the result is the same.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocab_path)
    shared = checked_broadcast(spark, ranks, sum(map(len, ranks)) + 16 * len(ranks))
    holder: dict[str, BpeCodec] = {}

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = holder.get("codec") or holder.setdefault("codec", BpeCodec(shared.value, pattern, entries=entries))
        ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())],
            names=["doc_id", "ids_le32", "decoded"],
        )

    def close() -> None:
        if holder:
            holder.pop("codec").close()

    return map_arrow(pick(docs, id_col, text_col), encode, SCHEMA, close)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids_le32") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids_le32", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
