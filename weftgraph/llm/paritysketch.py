"""N-gram Jaccard self-join by parity sketches.

A document is its set of hashed word shingles. Two sets with J >= t differ in at
most (|A| + |B|) (1 - t) / (1 + t) shingles. Sizes fall into bands whose bounds
grow by 1/t, so partners lie in one band or in neighbours; for each pair of
neighbouring bands there is a largest difference D. A sketch has a 64-bit word
for each of its parts; a shingle XORs its hash into one of them, which is the
parity of a very wide bit sketch, folded linearly. A shingle in only one of two
sets changes one word, so the Hamming distance of two sketches, counted in words,
is at most the difference of their sets, and with D + 1 words one must agree.
There are a few words more, so that a document may leave out as many empty words
and still share one that is not; a document with more empty words leaves out
none. Documents that share a word are candidates.

Equal sets are one node from the start. Small buckets list their pairs, and a pair
is a candidate if it shares as many words as a link must. In a large bucket the
node whose words are shared most is the centre, and all members are candidates
with it. Candidates are verified on the exact shingle sets and their links are
contracted. Large buckets that still hold several components are packed into
blocks, a row for each BLOCK members, and blocks are compared as wholes: pairs of
different components whose parity bits allow a link join them in a forest, whose
edges are verified. Where one of these fails, it may hide a link between components
of its tree, and a second comparison lists every pair among these that is still in
different components. Each node has a home, its largest bucket;
two nodes of one home are compared there and not again in other buckets. So every
link is found or lies inside a component, and no pair is a row before its sketches
allow a link.

Hot parts are found on a fixed sample of nodes; their rows are known to have
partners and need not be shuffled to find them. Everything else covers all rows.

Defined cases: null and empty texts have an empty set and link with nothing, as
do rows with a null id; a text of fewer words than a shingle is one shingle; texts
of any length are one set; repeated rows are equal sets; a similarity that equals the
threshold links. Empty tables give empty results. Columns besides the id and the text
are not read, whatever they are called; keep_one() returns them as they are. Shingles
and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import byte_texts, checked_broadcast, cut, forget, give_back, hash_filter, map_arrow, maybe_in, pick, release, small_batches, stored, without_ids
from weftgraph.operators.components import connected

CACHE_WORDS = 120_000
PASSES = 4
#: The lowest bits of a key hold the number of the lower of its two bands, plus one.
PAIR_MASK = 4095
#: Sets are smaller than this; the bands cover it at every threshold up to 99.
MOST = 1 << 31
SMALL = 8
BLOCK = 1024
HOT_SAMPLE, HOT_COUNT, HOT_KEYS = 64, 8, 200_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Join:
    """J >= num / 100 on shingles of `words` words, num in 1..100."""

    words: int = 5
    num: int = 80

    def __post_init__(self):
        if self.words < 1 or not 1 <= self.num <= 100:
            raise ValueError("at least one word and a threshold of 1 to 100 are needed")
        if self.num < 100 and len(self.lows()) > PAIR_MASK:
            raise ValueError("too many bands for a key")

    def band(self, n: int) -> int:
        """The largest i with low(i) <= n."""
        return int(np.searchsorted(self.lows(), n, "right")) - 1

    def lows(self) -> np.ndarray:
        """Lower bounds of the bands; sizes t apart lie in neighbouring bands.

        At a threshold of 100 only equal sets link, which needs no bands.
        """
        lows = [1]
        if self.num == 100:
            return np.array([1, MOST, MOST], np.int64)
        while lows[-1] < MOST:
            lows.append(max(lows[-1] + 1, lows[-1] * 100 // self.num + 1))
        return np.array(lows, np.int64)

    def parts(self, lows: np.ndarray, i: int) -> tuple[int, int]:
        """(number of parts, slack) for bands i and i + 1; no parts where only equal sets link."""
        if i + 2 >= len(lows):
            return 0, 0
        most = (int(lows[i + 2]) - 1 + int(lows[i + 1]) - 1) * (100 - self.num) // (100 + self.num)
        if most < 1:
            return 0, 0
        slack = 1 + most // 24
        return most + 1 + slack, slack


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, join: Join):
        self.join = join
        self.known: dict[bytes, int] = _Hashes()
        rng = np.random.default_rng(5)
        self.odd = [np.uint64(x) for x in rng.integers(1 << 62, 1 << 63, join.words, dtype=np.uint64) * 2 + 1]

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = text.translate(LOWER).split() if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.join.words, len(ws))
        s = np.full(len(ws) - k + 1, np.uint64(k))
        for i in range(k):
            s = (s ^ h[i : len(h) - k + 1 + i]) * self.odd[i]
            s ^= s >> np.uint64(29)
        return np.unique(s * np.uint64(0x9E3779B97F4A7C15))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def sketch(shingles: np.ndarray, n_parts: int) -> np.ndarray:
    """XOR of the shingles' hashes in each part."""
    part = ((shingles >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
    h = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(n_parts, np.uint64)
    np.bitwise_xor.at(out, part, h ^ (h >> np.uint64(32)))
    return out.view(np.int64)


def _strong(parts: np.ndarray, slack: int) -> np.ndarray:
    """Places of the words to emit: all but the empty ones, or all if too many are empty."""
    strong = np.flatnonzero(parts)
    return strong if len(parts) - len(strong) <= slack else np.arange(len(parts))


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of a power of two of bits, at least twice their number.

    Halves can be folded by XOR, so sketches of any two sizes compare; their Hamming
    distance is at most the difference of the sets.
    """
    m = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount(((shingles >> np.uint64(7)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little")


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bytes: halves XORed until it has the size."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def bits_distance(x: np.ndarray, y: np.ndarray) -> int:
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


SETS = "doc_id bigint, n bigint, node bigint, band int, bits binary, upper binary, lower binary"


def shingle_sets(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, node (hash of the set) and the sketches against the band above and below."""
    holder: dict = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.update(shingler=Shingler(join), lows=join.lows())
        lows = holder["lows"]
        n, node, band, bits, upper, lower = [], [], [], [], [], []
        for text in byte_texts(batch.column(1)):
            s = holder["shingler"](text)
            n.append(len(s))
            node.append(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None)
            i = int(np.searchsorted(lows, len(s), "right")) - 1
            band.append(i)
            bits.append(parity_bits(s).tobytes() if len(s) else b"")
            for out, b in ((upper, i), (lower, i - 1)):
                count = join.parts(lows, b)[0] if b >= 0 and len(s) else 0
                out.append(sketch(s, count).tobytes() if count else b"")
        kind = pa.binary()
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(band, pa.int32()), pa.array(bits, pa.binary()), pa.array(upper, kind), pa.array(lower, kind)],
            names=["doc_id", "n", "node", "band", "bits", "upper", "lower"],
        )

    return map_arrow(pick(docs, id_col, text_col), one, SETS)


def part_keys(nodes: DataFrame, join: Join, turn: int | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, node): a row for each emitted part; nodes has node, band, upper, lower.

    With a turn, only those of every PASSES-th pair of bands; with keep, only those
    whose keys it marks. It runs in the same worker: a second operator behind this
    one would hold a second worker for each task.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lows = join.lows()
        keys, owner = [], []
        bands = batch.column(1).to_pylist()
        for side, column in ((0, batch.column(2)), (-1, batch.column(3))):
            for r, (b, raw) in enumerate(zip(bands, column.to_pylist(), strict=True)):
                parts = np.frombuffer(raw, np.int64)
                if len(parts) and (turn is None or (b + side) % PASSES == turn):
                    at = _strong(parts, join.parts(lows, b + side)[1])
                    seed = np.uint64(0xC2B2AE3D27D4EB4F) * (np.uint64(b + side + 1) * np.uint64(1 << 32) + at.astype(np.uint64))
                    k = (parts[at].view(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
                    k = (k ^ (k >> np.uint64(31)) ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                    k = (k ^ (k >> np.uint64(32))) & ~np.uint64(PAIR_MASK) | np.uint64(b + side + 1)
                    keys.append(k.view(np.int64))
                    owner.append(np.full(len(at), r))
        flat_keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        rows = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        if keep is not None:
            kept = keep(flat_keys)
            flat_keys, rows = flat_keys[kept], rows[kept]
        return pa.RecordBatch.from_arrays([pa.array(flat_keys), pa.array(batch.column(0).to_numpy()[rows] if len(rows) else np.zeros(0, np.int64))], names=["key", "node"])

    with np.errstate(over="ignore"):
        return map_arrow(nodes.select("node", "band", "upper", "lower"), one, "key bigint, node bigint")


def shared_parts(nodes: DataFrame, join: Join, turn: int, hot: DataFrame) -> DataFrame:
    """(key, node, size): the rows of part_keys() that two nodes have, with the number of these.

    Hot keys are counted where they are, with map-side combining, and their rows are
    not shuffled; other keys meet in a shuffle and are counted there.
    """
    spark = nodes.sparkSession
    known = np.array(sorted(r[0] for r in hot.collect()), np.int64)  # at most HOT_KEYS
    size = F.count("*").over(Window.partitionBy("key")).alias("size")
    if not len(known):
        return part_keys(nodes, join, turn).select("key", "node", size).where("size > 1")
    hots = checked_broadcast(spark, known, 8 * len(known))

    warm = part_keys(nodes, join, turn, lambda keys: np.isin(keys, hots.value))
    counts = F.broadcast(warm.groupBy("key").agg(F.count("*").alias("size")))  # at most HOT_KEYS rows
    cold = part_keys(nodes, join, turn, lambda keys: ~np.isin(keys, hots.value))
    return cold.select("key", "node", size).where("size > 1").unionByName(warm.join(counts, "key").select("key", "node", "size"))


def links(edges: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The edges (a, b) with J >= t; sets has node and blob (sorted hashes).

    An a with many edges is salted: its set is copied once for each 256 of them.
    """
    load = edges.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("copies"))
    salted = edges.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
    left = sets.join(load, sets["node"] == load["a"]).select("a", F.col("blob").alias("x"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("blob").alias("y")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "x", "y")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(s, t)
            common = int((s[np.minimum(at, len(s) - 1)] == t).sum())
            ok.append(100 * common >= join.num * (len(s) + len(t) - common))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, verify, "a bigint, b bigint").distinct()


def may_link(edges: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The edges (a, b) whose parity bits do not rule a link out; nodes has node, n and bits."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            ok.append(bits_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + join.num) <= (n + m) * (100 - join.num))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, one, "a bigint, b bigint")


def _compare(left: list, right: list, same: bool, key: int, num: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b) of the pairs of two blocks in different components whose parity bits allow a link.

    Pairs of one home are left to that bucket. With forest, only pairs that join
    components not yet joined by those before.
    """
    least = min(len(r["bits"]) for r in (*left, *right))

    def arrays(rows: list) -> tuple:
        words = np.stack([folded(np.frombuffer(r["bits"], np.uint8), least) for r in rows]).view(np.uint64)
        return words, *(np.array([r[c] for r in rows], np.int64) for c in ("node", "label", "n", "home"))

    (x, node_x, label_x, nx, home_x), (y, node_y, label_y, ny, home_y) = arrays(left), arrays(right)
    root: dict[int, int] = {}

    def top(label: int) -> int:
        while label in root:
            label = root[label]
        return label

    homes = np.unique(home_x)
    if len(homes) <= 32:
        parts = [(np.flatnonzero(home_x == h), np.flatnonzero((home_y != h) | (h == key))) for h in homes.tolist()]
    else:  # all pairs, which covers more than it must
        parts = [(np.arange(len(x)), np.arange(len(y)))]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own, others in parts:
        if not len(others):
            continue
        rows = max(1, (1 << 20) // len(others))
        for some in np.split(own, range(rows, len(own), rows)):
            distance = np.zeros((len(some), len(others)), np.uint32)
            for c in range(x.shape[1]):
                distance += np.bitwise_count(x[some, c][:, None] ^ y[others, c][None, :])
            ok = distance * np.int64(100 + num) <= (nx[some][:, None] + ny[others][None, :]) * np.int64(100 - num)
            ok &= label_x[some][:, None] != label_y[others][None, :]
            if same:
                ok &= some[:, None] < others[None, :]
            i, j = np.nonzero(ok)
            i, j = some[i], others[j]
            if forest:
                kept = []
                for p, (s, t) in enumerate(zip(label_x[i].tolist(), label_y[j].tolist(), strict=True)):
                    s, t = top(s), top(t)
                    if s != t:
                        root[max(s, t)] = min(s, t)
                        kept.append(p)
                i, j = i[kept], j[kept]
            a.append(np.minimum(node_x[i], node_y[j]))
            b.append(np.maximum(node_x[i], node_y[j]))
    return np.concatenate(a), np.concatenate(b)


def candidates(sized: DataFrame, nodes: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of small buckets that share enough words, and the stars (a, b) of large ones.

    sized has key, node and size (of the bucket), nodes has node, n and band. A pair
    with d shingles in only one set at most shares all but d of the words of its pair
    of bands; some of them may be empty, and some in large buckets, which are not
    listed.
    """
    lows = join.lows()
    needed = [max(p - s, 0) for p, s in (join.parts(lows, i) for i in range(len(lows) - 2))] or [0]
    pair = F.col("key").bitwiseAND(F.lit(PAIR_MASK).cast("long")).cast("int") - 1
    small = sized.where(F.col("size") <= SMALL)
    big = sized.where(F.col("size") > SMALL)
    hidden = big.groupBy("node", pair.alias("pair")).agg(F.count("*").alias("hidden"))
    shared = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b")
    shared = shared.groupBy("a", "b", pair.alias("pair")).agg(F.count("*").alias("shared"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("band").alias(f"band{x}"))
    shared = shared.join(side("a"), "a").join(side("b"), "b").where(F.least("banda", "bandb") == F.col("pair"))
    shared = shared.join(hidden.toDF("a", "pair", "ha"), ["a", "pair"], "left").join(hidden.toDF("b", "pair", "hb"), ["b", "pair"], "left")
    most = F.floor((F.col("na") + F.col("nb")) * (100 - join.num) / (100 + join.num))
    least = F.get(F.array(*[F.lit(x).cast("long") for x in needed]), F.col("pair")) - most
    listed = shared.where(F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= least).select("a", "b")
    weight = big.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = big.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    stars = big.join(centres, "key").where("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    return listed, stars.distinct()


def residual(big: DataFrame, labels: DataFrame, nodes: DataFrame, join: Join, forest: bool) -> DataFrame:
    """Pairs (a, b) of large buckets that are not yet in one component and may link.

    big has key, node and home, which is the key of the node's largest bucket.
    """
    named = big.join(labels, "node", "left").select("key", "node", "home", F.coalesce("label", "node").alias("label"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("label", "home")]
    several = named.groupBy("key").agg(*ends, F.count("*").alias("size")).where("min_label < max_label AND (min_home < max_home OR min_home = key)").select("key", "size")
    large = stored(named.join(several, "key"))
    if large.isEmpty():
        return large.select(F.col("node").alias("a"), F.col("node").alias("b"))
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    full = large.join(nodes.select("node", "n", "bits"), "node")
    dealt = full.select("key", "size", F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("i"), F.struct("node", "label", "n", "home", "bits").alias("row"))
    # About BLOCK rows in each: a hash deals the members, so no block gathers a whole bucket.
    blocks = dealt.groupBy("key", "i").agg(F.collect_list("row").alias("rows"), F.first("size").alias("size"))
    j = F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("j")
    meet = blocks.select("key", "i", j, "rows").select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "rows")
    small_batches(big.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))
        rows = table.column("rows").to_pylist()
        a = b = np.zeros(0, np.int64)
        if p == q or len(rows) == 2:  # a block may have no partner
            a, b = _compare(rows[0], rows[-1], p == q, key, join.num, forest)
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meet.groupBy("key", "p", "q").applyInArrow(compare, "a bigint, b bigint").distinct()


def suspects(big: DataFrame, labels: DataFrame, forest: DataFrame, links_: DataFrame) -> DataFrame:
    """The rows of big whose component is in a tree of the forest (a, b) with an edge that is no link."""
    def named(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.join(labels.toDF(c, "__label"), c, "left").select("*", F.coalesce("__label", c).alias(name)).drop("__label")

    edges = named(named(forest, "a", "la"), "b", "lb")
    trees = connected(edges.select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("la", "tree")
    bad = edges.join(links_, ["a", "b"], "left_anti").join(trees, "la").select("tree").distinct()
    return named(big, "node", "la").join(trees.join(bad, "tree", "left_semi"), "la", "left_semi").select(*big.columns)


def near_duplicates(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs.

    component_id is the smallest doc_id reachable by links, class_id the smallest
    with an equal set.
    """
    spark = docs.sparkSession
    base = pick(docs, id_col, text_col).toDF("doc_id", "text")
    whole = stored(shingle_sets(base, join))
    sets = stored(whole.select("doc_id", "n", "node"))
    member = whole.where("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = sets.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    # A node's sketches are those of any row with its set. Only sets that may occur
    # twice are shuffled, and combined before that.
    may = member.where((F.octet_length("upper") > 0) | (F.octet_length("lower") > 0))
    again = hash_filter(may.groupBy("node").count().where("count > 1").select(F.col("node").alias("h")))
    marked = maybe_in(may, "node", again, "again").withColumnRenamed("doc_id", "rep")
    columns = ["node", "rep", "n", "band", "bits", "upper", "lower"]
    grouped = stored(marked.where("again").groupBy("node").agg(F.min_by(F.struct(*columns[1:]), "rep").alias("r")).select("node", *[f"r.{c}" for c in columns[1:]]))
    sketched = marked.where("NOT again").select(*columns).unionByName(grouped)
    sample = part_keys(sketched.where(F.pmod(F.xxhash64("node"), F.lit(HOT_SAMPLE)) == 0), join)
    hot = sample.groupBy("key").count().where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key")
    # Pairs of bands take turns, so that only a part of the words is on disk at once.
    turns = []
    for turn in range(PASSES):
        turns.append(stored(shared_parts(sketched, join, turn, hot)))
        release(spark)
    nodes = stored(sketched.select("node", "rep", "n", "band", "bits"))
    forget(whole, grouped)  # the sketches have done their work
    sized = reduce(DataFrame.unionByName, turns)
    listed, stars = candidates(sized, nodes, join)
    stars = stored(listed.unionByName(stars).distinct())
    big = sized.where(F.col("size") > SMALL).select("key", "node", "size")
    homes = big.groupBy("node").agg(F.max_by("key", F.struct("size", "key")).alias("home"))
    big = stored(big.join(homes, "node").select("key", "node", "home"))
    forget(*turns)
    release(spark)

    holder: dict = {}

    def blobs(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler = holder.get("s") or holder.setdefault("s", Shingler(join))
        got = [shingler(t) for t in byte_texts(batch.column(0))]
        node = [np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64) if len(s) else None for s in got]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "blob"])

    def verified(edges: DataFrame) -> DataFrame:
        """Links among candidates, on sets made anew from the few texts that are needed."""
        edges = stored(may_link(edges, nodes, join))
        ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        ids = cut(nodes.select("node", "rep").join(ends, "node", "left_semi").select("rep").distinct())
        hashed = base.withColumn("id_hash", F.xxhash64("doc_id"))
        near = maybe_in(hashed, "id_hash", hash_filter(ids.select(F.xxhash64("rep").alias("h"))), "near").where("near")
        exact = map_arrow(near.join(ids, near["doc_id"] == ids["rep"], "left_semi").select("text"), blobs, "node bigint, blob binary").where("node IS NOT NULL")
        exact = stored(exact)
        out = cut(links(edges, exact, join))
        forget(edges, ids, exact)
        release(spark)
        return out

    # Stars, then a forest of what joins components, then what a failed edge of it may hide.
    found = verified(stars)
    labels = connected(found)
    forest = cut(residual(big, labels, nodes, join, forest=True))
    release(spark)
    if not forest.isEmpty():
        asked = cut(forest.join(stars, ["a", "b"], "left_anti"))
        found = cut(found.unionByName(verified(asked)))
        before, labels = labels, connected(found)
        hidden = stored(suspects(big, before, forest, found))
        rest = cut(residual(hidden, labels, nodes, join, forest=False).join(stars.unionByName(asked), ["a", "b"], "left_anti"))
        release(spark)
        if not rest.isEmpty():
            labels = connected(found.unionByName(verified(rest)))
    placed = classes.join(labels, "node", "left").select("node", "class_id", F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = placed.join(least, "label").select("node", "class_id", "component_id")
    out = sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def keep_one(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component; rows that repeat it are made one.

    Texts without words and rows with a null id stay.
    """
    found = near_duplicates(docs, join, id_col, text_col)
    left = without_ids(docs, id_col, cut(found.where("component_id < doc_id").select("doc_id")))
    again = cut(pick(docs, id_col).groupBy(F.col(f"`{id_col}`").alias("id")).count().where("count > 1 AND id IS NOT NULL").select("id"))
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == again["id"], "left_semi").dropDuplicates([id_col])
    return without_ids(left, id_col, again).unionByName(once)
