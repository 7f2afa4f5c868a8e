"""Line dedup by a segment-partition edit join.

A line is dropped when an earlier line (by doc_id, then line number) is equal to
it or within `edits` edits of it. Equal lines are one, known by two 64-bit hashes;
pairs are found by the first of them and verified on the texts.
Each distinct line is cut into edits + 1 segments, one of which any line within
that distance holds unchanged. Segments are indexed by (length, number, text);
a line probes, for each length up to `edits` shorter than its own, only the
substrings that can align with a segment (multi-match-aware selection). Pairs
that meet pass a second pigeonhole test (of 3 * edits pieces all but `edits`
must occur near their place) and are verified by the banded bit-parallel
recurrence on what their common prefix and suffix leave.

A segment in more than about HOT lines, as a fixed sample of documents by hash
shows, is hot: there, pairs meet in the same equi-join
with the condition that parity sketches of their characters and pairs of
characters differ in few bits, so that only pairs that may match leave the join.

Only DataFrame functions run. Hot equal lines are combined before they are
shuffled; a document's own line numbers are the only lists that are gathered.

Defined cases: null texts have no lines; an empty text has one empty line; lines
shorter than min_chars are never dropped and drop nothing; lines of any length are
compared whole; rows that repeat a doc_id are one document, in which equal places
never drop each other; a null doc_id comes after all others. Empty tables give empty
results, and other columns are not read; remove_lines() returns them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, fresh, hash_filter, maybe_in, pick, stored

EDITS = 2
MIN_CHARS = 20
HOT, SAMPLE = 24, 8
BROADCAST_KEYS = 100_000


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line cut into k + 1; later ones are longer by one."""
    size = F.floor(length / (k + 1)).cast("int")
    longer = (length % (k + 1)).cast("int")
    start = size * i + F.greatest(F.lit(0), F.lit(i - k - 1) + longer)
    return start, size + F.when(longer > k - i, 1).otherwise(0)


def keys(line: Column, k: int) -> Column:
    """Hashes of (length, number, substring) of a line, with the role in the lowest bit.

    These are all substrings that can align with a segment of a line up to k
    shorter; the bit is set for the line's own segments, which are the index. The
    line is taken as four bytes for each character, where a substring is found
    without a scan, and the keys are one lambda, small enough to be compiled.
    """

    def of(units: Column) -> Column:
        out = []
        for shorter in range(k + 1):
            n = F.shiftright(F.octet_length(units), 2) - shorter
            for i in range(k + 1):
                start, size = _segment(n, i, k)
                for shift in range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1):
                    own = shorter == 0 and shift == 0
                    h = F.xxhash64(n, F.lit(i), F.substring(units, (start + shift) * 4 + 1, size * 4))
                    out.append(h.bitwiseOR(F.lit(1).cast("long")) if own else h.bitwiseAND(F.lit(-2).cast("long")))
        return F.array(*out)

    return F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), of))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def common_prefix(x: Column, y: Column, bits: int = 20) -> Column:
    """Length of the common prefix, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    least = F.least(F.length(x), F.length(y))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= least) & (F.left(x, n + s) == F.left(y, n + s)), n + s).otherwise(n))


def _chars(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def _band(xs: Column, ys: Column, apart: Column, k: int) -> Column:
    """The band after all characters of ys: words vp, vn and d on the diagonal `apart`.

    Bit i of each word is row j - k + i of column j: the band moves down one row
    for each character. d grows wherever the step on its diagonal is not free.
    """
    width = 2 * k + 1
    mask = (1 << width) - 1
    m = lambda c: c.bitwiseAND(F.lit(mask).cast("long"))

    def match(j: Column) -> Column:
        bits = [F.when(F.get(xs, j - 1 - k + i) == F.get(ys, j - 1), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(width)]
        return reduce(lambda a, b: a + b, bits)

    def step(s: Column, pm: Column) -> Column:
        free = m((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]))

        def move(d0: Column) -> Column:
            hp = m(s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))))
            down = F.shiftright(d0, 1)
            return F.struct(
                m(d0.bitwiseAND(s["vp"]).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["d"] + F.when(d0.bitwiseAND(s["diagonal"]) == 0, 1).otherwise(0)).alias("d"),
                s["diagonal"].alias("diagonal"),
            )

        return let(free, move)

    powers = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
    start = F.struct(F.lit(mask & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), apart.alias("d"), F.get(powers, apart + k).alias("diagonal"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(ys)), match), start, step)


def banded_distance(x: Column, y: Column, k: int) -> Column:
    """Edit distance of x and y if it is at most k, else any number above k; |x| - |y| in 0..k."""
    whole = lambda p: _band(p["x"], p["y"], F.size(p["x"]) - F.size(p["y"]), k)["d"]
    return F.when(F.length(y) == 0, F.length(x)).otherwise(let(F.struct(_chars(x).alias("x"), _chars(y).alias("y")), whole))


def window_bound(x: Column, y: Column, k: int, window: int = 12) -> Column:
    """A lower bound of banded_distance() from the first characters: the least cell of the band."""
    apart = F.length(x) - F.length(y)
    low = F.array(*[F.lit((1 << (a + k)) - 1).cast("long") for a in range(k + 1)])

    def least(p: Column) -> Column:
        def of(s: Column) -> Column:
            up = F.get(low, p["apart"])
            return s["d"] - F.greatest(F.bit_count(s["vp"].bitwiseAND(up)), F.bit_count(s["vn"].bitwiseAND(F.bitwise_not(up))))

        return let(_band(p["x"], p["y"], p["apart"], k), of)

    start = F.struct(_chars(F.left(x, F.lit(window + k))).alias("x"), _chars(F.left(y, F.lit(window))).alias("y"), apart.alias("apart"))
    return F.when(F.length(y) == 0, F.length(x)).otherwise(let(start, least))


def trimmed_distance(x: Column, y: Column, k: int) -> Column:
    """banded_distance() of any two strings, of what their common prefix and suffix leave.

    What is left differs at both ends; most pairs too far apart show it in the
    first characters.
    """
    long_, short = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)

    def core(p: Column) -> Column:
        a, b = F.substr(p["x"], p["n"] + 1), F.substr(p["y"], p["n"] + 1)
        left = lambda q: F.struct(F.left(q["a"], F.length(q["a"]) - q["tail"]).alias("x"), F.left(q["b"], F.length(q["b"]) - q["tail"]).alias("y"))
        rest = let(F.struct(a.alias("a"), b.alias("b")), lambda q: let(F.struct(q["a"].alias("a"), q["b"].alias("b"), common_prefix(F.reverse(q["a"]), F.reverse(q["b"])).alias("tail")), left))
        return let(rest, lambda q: F.when(window_bound(q["x"], q["y"], k) > k, k + 1).otherwise(banded_distance(q["x"], q["y"], k)))

    far = F.length(long_) - F.length(short) > k
    pair = F.struct(long_.alias("x"), short.alias("y"))
    return F.when(far, k + 1).otherwise(let(pair, lambda p: let(F.struct(p["x"].alias("x"), p["y"].alias("y"), common_prefix(p["x"], p["y"]).alias("n")), core)))


def pieces_near(x: Column, y: Column, k: int) -> Column:
    """How many of 3k pieces of x occur in y within k characters of their place."""
    n = F.length(x)
    count = 3 * k
    found = F.lit(0)
    for i in range(count):
        start, end = F.floor(n * i / count).cast("int"), F.floor(n * (i + 1) / count).cast("int")
        window = F.substring(y, F.greatest(start - k, F.lit(0)) + 1, end - start + 2 * k)
        found = found + F.when(F.instr(window, F.substring(x, start + 1, end - start)) > 0, 1).otherwise(0)
    return found


def sketches(line: Column) -> Column:
    """Parity sketches of a line's characters (2 flips an edit at most) and of its pairs of characters (4)."""
    flip = lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    zero = F.lit(0).cast("long")

    def of(chars: Column) -> Column:
        pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
        return F.struct(F.aggregate(chars, zero, flip).alias("one"), F.aggregate(pairs, zero, flip).alias("two"))

    return let(F.split(line, ""), of)


def distinct_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h, line), each line once; repeated has the hashes that occur twice.

    Only lines that may be repeated are shuffled, and combined before that.
    """
    marked = maybe_in(lines, "h", hash_filter(repeated), "again")
    once = cut(marked.where("again").groupBy("h").agg(F.min("line").alias("line")))
    return marked.where("NOT again").select("h", "line").unionByName(once)


def _split_keys(lines: DataFrame, k: int) -> DataFrame:
    """(key, index, h): a row for each key of each line."""
    raw = lines.select("h", F.explode(keys(F.col("line"), k)).alias("raw"))
    one = F.lit(1).cast("long")
    return raw.select(F.col("raw").bitwiseAND(F.lit(-2).cast("long")).alias("key"), (F.col("raw").bitwiseAND(one) == 1).alias("index"), "h")


def similar_lines(lines: DataFrame, unique: DataFrame, sample: DataFrame, k: int = EDITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct lines within k edits.

    lines has h and line, unique the same with each line once, sample the lines of
    one document in SAMPLE.
    """
    n_parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = _split_keys(unique, k)
    drawn = _split_keys(sample, k).where("index").select("key", "h").distinct()
    hot = cut(drawn.groupBy("key").count().where(F.col("count") * SAMPLE > HOT).select("key"))
    n_hot = hot.count()
    known = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    # One exchange serves all readers: filters that are not deterministic keep what is
    # above from moving below it, and both sides of the join keep the same columns.
    dealt = every.repartition(n_parts, "key")
    x = dealt.where(F.when(F.spark_partition_id() >= 0, F.col("index")).otherwise(False)).select("key", F.col("h").alias("a"))
    x = x.join(known, "key", "left_anti") if n_hot else x
    y = dealt.select("key", F.col("h").alias("b"), F.col("index").alias("too"))
    # Two index rows meet twice; once is enough.
    met = x.join(y, "key").where("a <> b AND NOT (too AND a > b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.lit(None).cast("long").alias("key"), F.lit(False).alias("index"))
    if n_hot:
        met = met.unionByName(dealt.where(F.spark_partition_id() >= 0).join(known, "key", "left_semi").select(F.col("h").alias("a"), F.lit(None).cast("long").alias("b"), "key", "index"))
    met = cut(met)
    named = hash_filter(met.select(F.col("a").alias("h")).unionByName(met.select(F.col("b").alias("h"))))
    needed = maybe_in(lines, "h", named, "needed").where("needed").groupBy("h").agg(F.min("line").alias("line"))
    needed = cut(needed.select("h", "line", sketches(F.col("line")).alias("s")))
    near = (F.bit_count(F.col("sx.one").bitwiseXOR(F.col("sy.one"))) <= 2 * k) & (F.bit_count(F.col("sx.two").bitwiseXOR(F.col("sy.two"))) <= 4 * k)
    pairs = met.where("b IS NOT NULL").select("a", "b")
    drawn = needed.select("h", "s")
    pairs = pairs.join(drawn.toDF("a", "sx"), "a").join(drawn.toDF("b", "sy"), "b").where(near).select("a", "b")
    if n_hot:
        rows = met.where("b IS NULL").select("key", "index", F.col("a").alias("h")).join(drawn, "h")
        x = rows.where("index").select("key", F.col("h").alias("a"), F.col("s").alias("sx"))
        y = rows.select("key", F.col("h").alias("b"), F.col("s").alias("sy"))
        both = x.join(y, (x["key"] == y["key"]) & (F.col("a") != F.col("b")) & near)
        pairs = pairs.unionByName(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    texts = pairs.join(needed.select("h", "line").toDF("a", "x"), "a").join(needed.select("h", "line").toDF("b", "y"), "b").repartition(n_parts)
    maybe = texts.where(F.least(pieces_near(F.col("x"), F.col("y"), k), pieces_near(F.col("y"), F.col("x"), k)) >= 2 * k)
    return maybe.where(trimmed_distance(F.col("x"), F.col("y"), k) <= k).select("a", "b")


def dropped_lines(docs: DataFrame, k: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_lines) of every document, and (doc_id, no, h) of every dropped line (no from 0)."""
    base = pick(docs, id_col, text_col).toDF("doc_id", "text")
    split_up = F.split("text", "\n", -1)
    # Line hashes only; the texts are read again where they are needed, but not shuffled.
    both = lambda s: F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g"))
    table = stored(base.select("doc_id", F.transform(split_up, lambda s: F.when(F.length(s) >= min_chars, both(s))).alias("hs")))
    sizes = table.groupBy("doc_id").agg(F.greatest(F.max(F.coalesce(F.size("hs"), F.lit(0))), F.lit(0)).cast("bigint").alias("n_lines"))
    places = table.select("doc_id", F.posexplode("hs").alias("no", "line")).where("line IS NOT NULL").select("doc_id", "no", "line.h", "line.g")
    # A null id comes last.
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("no"))
    firsts = cut(places.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).select("h", "g", "first", (F.col("n") > 1).alias("again")))

    def lines_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(split_up).alias("line")).where(F.length("line") >= min_chars).select(F.xxhash64("line").alias("h"), "line")

    lines, sample = lines_of(base), lines_of(base.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))
    pairs = cut(similar_lines(lines, distinct_lines(lines, firsts.where("again")), sample, k))
    ends = pairs.select(F.col("a").alias("h"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("h"), F.col("a").alias("near")))
    earlier = ends.join(firsts.select(F.col("h").alias("near"), "first"), "near").groupBy("h").agg(F.min("first").alias("other"))
    limits = firsts.join(earlier, "h", "left").where("again OR other < first")
    limits = cut(limits.select("h", "g", F.least("first", F.coalesce("other", "first")).alias("first")))
    places = maybe_in(places, "h", hash_filter(limits), "limited").where("limited").drop("limited")
    return sizes, places.join(limits, ["h", "g"]).where(place > F.col("first")).select("doc_id", "no", "h")


def dropped_by_document(docs: DataFrame, k: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, ascending) of every document."""
    sizes, dropped = dropped_lines(docs, k, min_chars)
    lists = dropped.groupBy("doc_id").agg(F.array_sort(F.collect_set("no")).alias("dropped")).withColumnRenamed("doc_id", "own_id")
    joined = sizes.join(lists, sizes["doc_id"].eqNullSafe(lists["own_id"]), "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size(F.coalesce("dropped", none)), F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def remove_lines(docs: DataFrame, k: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of the text; all columns and rows stay."""
    _, dropped = dropped_lines(docs, k, min_chars, id_col, text_col)
    gone, own_id = fresh("__gone", docs.columns), fresh("__own_id", docs.columns)
    lists = dropped.groupBy("doc_id").agg(F.collect_set(F.struct("no", "h")).alias(gone)).withColumnRenamed("doc_id", own_id)
    of = {c: docs[f"`{c}`"] for c in docs.columns}
    joined = docs.join(lists, of[id_col].eqNullSafe(lists[own_id]), "left")
    parts = F.split(of[text_col], "\n", -1)
    left = F.filter(parts, lambda s, i: ~F.array_contains(F.col(gone), F.struct(i.alias("no"), F.xxhash64(s).alias("h"))))
    text = F.when(F.col(gone).isNull(), of[text_col]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else of[c] for c in docs.columns])
