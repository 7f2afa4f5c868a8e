"""Benchmark decontamination by suffix arrays over the training text.

Each executor cuts the documents it reads into shards of bounded bytes and sorts
the shard's word suffixes by prefix doubling, up to the length of the longest
benchmark item. Only suffixes that begin with a benchmark word are in the array, as
no other can match. Every benchmark suffix is binary-searched in it for its first
WINDOW words; the range it finds holds all its occurrences, and each is extended
word by word to the longest verbatim match. Matches that another one holds are left
out.

The benchmark is split by a hash of item_id into blocks of measured, bounded
size. Each block is one broadcast and one pass in the same stage, so nothing
depends on the benchmark fitting into memory at once; after MAX_BLOCKS of them the
result so far is cut, and the next ones go on from there.

Defined cases: null and empty texts have no words; an item without words is
never found; an item shorter than the window is one window; repeated item ids
count once; of equally long matches of one item the first in the text is told;
repeated document rows are judged one by one; a text longer than a shard is a shard
of its own; empty tables on either side give zero hits or no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import byte_texts, checked_broadcast, cut, map_arrow, pick, without_ids

WINDOW = 8
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
MAX_BLOCKS = 32

#: A-Z become a-z; every other byte below 0x80 that is no digit or a-z ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

MATCH = "struct<item_id:bigint,doc_start:int,item_start:int,n_words:int>"
SCHEMA = f"doc_id bigint, n_words bigint, n_hit bigint, hits array<int>, matches array<{MATCH}>"
_MATCH = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class TestSuffixes:
    """The suffixes of a block of benchmark items, their first words packed for binary search.

    text holds all items one after the other, each before and after a 0; place is where
    a suffix begins there.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        texts = [(i, words(t)) for i, t in items]
        self.vocab = {w: n for n, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        self.bits = max(1, len(self.vocab).bit_length())
        self.per_key = max(1, min(window, 62 // self.bits))
        self.n_keys = -(-window // self.per_key)
        item, start, size, rows, place, flat = [], [], [], [], [], [0]
        for i, ws in texts:
            ids = [self.vocab[w] for w in ws]
            m = min(window, len(ids))
            place.extend(range(len(flat), len(flat) + len(ids) - m + 1) if m else ())
            flat += [*ids, 0]
            for j in range(len(ids) - m + 1 if m else 0):
                item.append(i)
                start.append(j)
                size.append(m)
                rows.append(ids[j : j + m] + [0] * (self.n_keys * self.per_key - m))
        self.item = np.array(item, np.int64)
        self.start = np.array(start, np.int64)
        self.size = np.array(size, np.int64)
        self.place = np.array(place, np.int64)
        self.text = np.array(flat, np.int64)
        self.longest = max((len(ws) for _, ws in texts), default=1)
        table = np.array(rows, np.int64).reshape(len(rows), self.n_keys * self.per_key)
        free = np.arange(table.shape[1]) >= self.size[:, None]
        self.low, self.high = self._pack(table), self._pack(np.where(free, (1 << self.bits) - 1, table))

    def _pack(self, table: np.ndarray) -> list[np.ndarray]:
        keys = []
        for k in range(self.n_keys):
            key = np.zeros(len(table), np.int64)
            for c in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << self.bits) | table[:, c]
            keys.append(key)
        return keys

class SuffixArray:
    """Positions of a stream of word ids (0 ends a suffix), in the order of their suffixes.

    Suffixes are compared on their first `depth` words at least, or up to where they end.
    """

    def __init__(self, stream: np.ndarray, bits: int, per_key: int, depth: int):
        self.bits, self.per_key = bits, per_key
        self.padded = np.concatenate([stream, np.zeros(2 * max(depth, per_key) + per_key, np.int64)])
        at = np.flatnonzero(stream)
        key = self.key(at)
        order = np.argsort(key, kind="stable")
        self.first, self.array = key[order], at[order]
        rank = np.zeros(len(self.padded), np.int64)
        head = np.ones(len(at), bool)
        head[1:] = self.first[1:] != self.first[:-1]
        rank[self.array] = self._heads(head) + 1
        known = per_key
        while known < depth:
            # Members of groups of several whose suffixes go on.
            several = ~head
            several[:-1] |= ~head[1:]
            open_ = np.flatnonzero(several & (self.padded[self.array + known] > 0))
            ended = np.flatnonzero(several & (self.padded[self.array + known] == 0))
            if len(open_) < 2:
                break
            some = np.sort(np.concatenate([open_, ended]))
            p = self.array[some]
            one, two = rank[p], rank[p + known]
            o = np.lexsort((two, one))
            p, one, two = p[o], one[o], two[o]
            self.array[some] = p
            new = np.ones(len(p), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            head[some] = new
            rank[p] = some[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))] + 1
            known *= 2

    @staticmethod
    def _heads(head: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))

    def key(self, at: np.ndarray) -> np.ndarray:
        """per_key words from some positions on, packed."""
        out = np.zeros(len(at), np.int64)
        for c in range(self.per_key):
            out = (out << self.bits) | self.padded[at + c]
        return out

    def _bisect(self, low: np.ndarray, high: np.ndarray, target: np.ndarray, skip: int, right: bool) -> np.ndarray:
        """In each range, the first place whose key after `skip` words is not below (or is above) the target."""
        low, high = low.copy(), high.copy()
        while True:
            go = np.flatnonzero(low < high)
            if not len(go):
                return low
            middle = (low[go] + high[go]) // 2
            key = self.key(self.array[middle] + skip)
            up = key <= target[go] if right else key < target[go]
            low[go] = np.where(up, middle + 1, low[go])
            high[go] = np.where(up, high[go], middle)

    def ranges(self, lows: list[np.ndarray], highs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each query the places whose leading words lie between its packed bounds."""
        low = np.searchsorted(self.first, lows[0], "left")
        high = np.searchsorted(self.first, highs[0], "right")
        for k in range(1, len(lows)):
            skip = k * self.per_key
            low, high = self._bisect(low, high, lows[k], skip, False), self._bisect(low, high, highs[k], skip, True)
        return low, np.maximum(low, high)


def _shard(tests: TestSuffixes, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[dict]]]:
    """Hit positions and longest matches of each document of one shard."""
    get = tests.vocab.get
    sizes = np.array([len(ws) for ws in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    stream = np.zeros(int((sizes + 1).sum()), np.int64)
    for s, ws in zip(starts, texts, strict=True):
        stream[s : s + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    matches: list[list[dict]] = [[] for _ in texts]
    if not stream.any() or not len(tests.item):
        return hits, matches
    suffixes = SuffixArray(stream, tests.bits, tests.per_key, tests.longest)
    low, high = suffixes.ranges(tests.low, tests.high)
    count = high - low
    if not count.any():
        return hits, matches
    window = np.repeat(np.arange(len(count)), count)
    pos = suffixes.array[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    size = tests.size[window]
    edge = np.zeros(len(stream) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + size, -1)
    covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    owner = np.searchsorted(starts, covered, "right") - 1
    for d in np.unique(owner):
        hits[d] = covered[np.searchsorted(owner, d, "left") : np.searchsorted(owner, d, "right")] - starts[d]
    # Occurrences that go on to the left belong to the match that begins there.
    place = tests.place[window]
    left = np.where(pos > 0, stream[np.maximum(pos - 1, 0)], 0)
    begins = (left == 0) | (left != tests.text[place - 1])
    window, pos, place, length = window[begins], pos[begins], place[begins], size[begins].copy()
    padded = suffixes.padded
    going = np.arange(len(pos))
    while len(going):
        ahead = padded[pos[going] + length[going]]
        going = going[(ahead > 0) & (ahead == tests.text[place[going] + length[going]])]
        length[going] += 1
    doc, item = np.searchsorted(starts, pos, "right") - 1, tests.item[window]
    order = np.lexsort((tests.start[window], pos, -length, item, doc))
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
    for n in order[first].tolist():
        d = int(doc[n])
        matches[d].append({"item_id": int(item[n]), "doc_start": int(pos[n] - starts[d]), "item_start": int(tests.start[window[n]]), "n_words": int(length[n])})
    return hits, matches


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document inside a benchmark window, and the longest matches.

    Returns doc_id, n_words, n_hit, hits (word positions) and matches: for each
    benchmark item found, the longest verbatim match with its places.
    """
    spark = docs.sparkSession
    items = pick(benchmark, "item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total, n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, -(-int(total + 16 * n) * 5 // (4 * block_bytes)))
    out = pick(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        F.lit(None).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast(f"array<{MATCH}>").alias("matches"),
    )
    for block in range(n_blocks):
        if block and block % MAX_BLOCKS == 0:
            out = cut(out)
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        rows = [(int(r[0]), r[1].encode()) for r in part.orderBy("item_id", "text").collect()]
        shared = checked_broadcast(spark, rows, sum(len(t) for _, t in rows), 4 * block_bytes)
        out = map_arrow(out, _pass(shared, window), "doc_id bigint, text string, n_words bigint, hits array<int>, matches array<" + MATCH + ">")
    return out.select("doc_id", F.col("n_words"), F.size("hits").cast("bigint").alias("n_hit"), "hits", "matches")


def _pass(shared, window: int):
    holder: dict[str, TestSuffixes] = {}

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        tests = holder.get("tests") or holder.setdefault("tests", TestSuffixes(shared.value, window))
        n_words, hits, matches = [], [], []
        shard: list[list[bytes]] = []

        def flush() -> None:
            h, m = _shard(tests, shard)
            hits.extend(h)
            matches.extend(m)
            shard.clear()

        held = 0
        for text in byte_texts(batch.column(1)):
            shard.append(words(text))
            n_words.append(len(shard[-1]))
            held += len(text or b"")
            if held >= SHARD_BYTES:
                flush()
                held = 0
        flush()
        before_hits, before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        hits = [np.union1d(np.array(b, np.int64), h) if b else h for b, h in zip(before_hits, hits, strict=True)]
        matches = [b + m for b, m in zip(before, matches, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array([h.tolist() for h in hits], pa.list_(pa.int32())), pa.array(matches, pa.list_(_MATCH))],
            names=["doc_id", "text", "n_words", "hits", "matches"],
        )

    return search


def item_digests(found: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of find_matches()."""
    ids = F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(ids) >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW) -> DataFrame:
    """The documents that hold windows of fewer than min_items benchmark items.

    All columns and repeated rows stay; rows with a null doc_id are judged too.
    """
    found = item_digests(find_matches(docs, benchmark, window), min_items)
    return without_ids(docs, "doc_id", cut(found.where("contaminated").select("doc_id")))
