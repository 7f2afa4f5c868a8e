"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

Segments are lines of every file (headers) and the whole text of files named as
licence files. A licence has several templates: its notice, its body, its SPDX
lines. Each distinct segment is compared with each template by the cosine of
TF-IDF vectors, with 1 + ln(count) as term weight; the idf counts templates, and a
word that no template has gets the idf of a word in none. A file's licence is that
of the best template at or above the threshold, ties go to the first name. A
licence file declares its licence for its directory; a file without one of its own
takes that of the nearest ancestor directory.

Every line of every text is looked at, and none that can reach the threshold is
left out: with M the squared weight of a segment's words that any template has, and
R that of its others, no cosine exceeds the root of M / (M + R). Lines below that
bound, as nearly all, are passed over where they are read, before any shuffle.

Only DataFrame functions run. Segments are made distinct before they are split
into words, so a line in a third of all files is compared once; inheritance is
found once per directory. What meets a hot line or directory is an equi-join
that adaptive execution splits.

Defined cases: null and empty texts have no segment; a null path has neither
directory nor licence from one. Of two licence files in a directory the better
score wins, then the first name. Repeated rows give repeated results. Empty tables
give empty results. Other columns of the table are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, pick
from weftgraph.llm.licence_texts import TEMPLATES
from weftgraph.llm.linededup import let

THRESHOLD = 0.6
WORD = r"[0-9A-Za-z]+(?:\.[0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates and their words are broadcast; this bounds them.
MAX_WORDS = 100_000


def template_weights(templates: dict[str, Sequence[str]]) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """idf of each template word, and (licence, vector of length one) of each template."""
    fold = str.maketrans(UPPER, LOWER)
    tf = [(k, Counter(re.findall(WORD, t.translate(fold)))) for k, texts in sorted(templates.items()) for t in texts]
    df = Counter(w for _, c in tf for w in c)
    idf = {w: math.log((1 + len(tf)) / (1 + n)) + 1 for w, n in sorted(df.items())}
    vectors = []
    for k, c in tf:
        x = {w: (1 + math.log(n)) * idf[w] for w, n in sorted(c.items())}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors.append((k, {w: v / norm for w, v in x.items()}))
    return idf, vectors


def may_reach(segment: Column, templates: dict[str, Sequence[str]], threshold: float) -> Column:
    """False only where no template can reach the threshold: the bound of the module, on upper bounds of idf."""
    idf, vectors = template_weights(templates)
    unknown = math.log(1 + len(vectors)) + 1
    by_idf = sorted(idf, key=lambda w: (idf[w], w))
    # Three classes of words, each with its greatest idf.
    classes = [c for c in (by_idf[: len(by_idf) // 20], by_idf[len(by_idf) // 20 : len(by_idf) // 4], by_idf[len(by_idf) // 4 :]) if c]
    least = (threshold - 1e-5) ** 2

    def weight(w: Column) -> Column:
        out = F.lit(idf[classes[-1][-1]])
        for c in reversed(classes[:-1]):
            out = F.when(w.isin(c), idf[c[-1]]).otherwise(out)
        return out

    def bound(words: Column) -> Column:
        def of(p: Column) -> Column:
            square = lambda w: F.pow((1 + F.ln(F.size(F.filter(p["words"], lambda x: x == w)))) * weight(w), F.lit(2.0))
            known = F.aggregate(p["known"], F.lit(0.0), lambda total, w: total + square(w))
            others = F.size(F.array_distinct(p["words"])) - F.size(p["known"])
            return (F.size(p["known"]) > 0) & (known * (1 - least) >= others * (least * unknown**2))

        return let(F.struct(words.alias("words"), F.array_distinct(F.filter(words, lambda w: w.isin(by_idf))).alias("known")), of)

    return let(words_of(segment), bound)


def words_of(segment: Column) -> Column:
    return F.transform(F.regexp_extract_all(segment, F.lit(f"({WORD})"), 1), F.lower)


def _frames(spark: SparkSession, templates: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame, float]:
    idf, vectors = template_weights(templates)
    if len(idf) > MAX_WORDS:
        raise ValueError("too many template words to broadcast")
    idf_rows = spark.createDataFrame(list(idf.items()), "word string, idf double")
    vector_rows = spark.createDataFrame([(w, i, k, x) for i, (k, v) in enumerate(vectors) for w, x in v.items()], "word string, template int, licence string, weight double")
    return F.broadcast(idf_rows), F.broadcast(vector_rows), math.log(1 + len(vectors)) + 1


def segment_scores(segments: DataFrame, templates: dict[str, Sequence[str]]) -> DataFrame:
    """h1, h2 (hashes of a segment), licence, score: the best template of each distinct segment."""
    idf, vectors, unknown = _frames(segments.sparkSession, templates)
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = (
        segments.distinct().select("segment", F.xxhash64("segment").alias("h1"), F.md5(F.col("segment").cast("binary")).alias("h2")).repartition(n, "h2")
        .select("h1", "h2", F.explode(words_of(F.col("segment"))).alias("word"))
    )
    tf = words.groupBy("h1", "h2", "word").agg(F.count("*").alias("tf")).join(idf, "word", "left")
    weighed = cut(tf.select("h1", "h2", "word", ((1 + F.ln("tf")) * F.coalesce("idf", F.lit(unknown))).alias("x")))
    norms = weighed.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dots = weighed.join(vectors, "word").groupBy("h1", "h2", "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["h1", "h2"]).select("h1", "h2", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scores.groupBy("h1", "h2").agg(F.max_by("licence", _rank("score", "licence")).alias("licence"), F.max("score").alias("score"))


def _rank(score: str, name: str) -> Column:
    """Orders by score, then by the first name (code points negated)."""
    return F.struct(F.col(score), F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c)))


def scan(files: DataFrame, templates: dict[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD, path_col: str = "path", text_col: str = "text", whole_col: str = "is_licence_file", id_col: str = "doc_id") -> DataFrame:
    """doc_id, path, own_licence, score, licence, inherited_from of every file.

    whole_col tells which files are licence files.
    """
    files = pick(files, id_col, path_col, text_col, whole_col).toDF("doc_id", "path", "text", "whole")
    path_dir = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"(?s)^(.*)/", 1)).otherwise(F.when(F.col("path").isNotNull(), ""))
    light = files.select("doc_id", "path", F.coalesce("whole", F.lit(False)).alias("whole"), path_dir.alias("dir"), "text")
    lines = F.split("text", "\n")
    parts = F.when(F.col("whole"), F.array_append(lines, F.col("text"))).otherwise(lines)
    # The texts are read once; what is kept are the few segments that may reach the threshold.
    split_up = light.where(F.length("text") > 0).select("doc_id", "path", "whole", "dir", F.explode(F.array_distinct(parts)).alias("segment"))
    split_up = cut(split_up.where(may_reach(F.col("segment"), templates, threshold)))
    light = light.drop("text")
    best = segment_scores(split_up.select("segment"), templates).where(F.col("score") >= threshold)
    keyed = split_up.select("doc_id", "path", "whole", "dir", F.xxhash64("segment").alias("h1"), F.md5(F.col("segment").cast("binary")).alias("h2"))
    own = (
        keyed.join(best, ["h1", "h2"]).groupBy("doc_id", "path", "whole", "dir")
        .agg(F.max_by("licence", _rank("score", "licence")).alias("own_licence"), F.max("score").alias("score"))
    )
    declared = own.where("whole AND dir IS NOT NULL").groupBy("dir").agg(F.max_by("own_licence", _rank("score", "own_licence")).alias("licence"))
    dirs = light.where("dir IS NOT NULL").select("dir").distinct()
    near = (
        dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
        .join(declared.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir").agg(F.max_by(F.struct("above", "licence"), F.length("above")).alias("near"))
    )
    found = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "own_licence", "score")
    joined = light.select("doc_id", "path", "dir").join(found, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").join(near, "dir", "left")
    return joined.select(
        "doc_id", "path", "own_licence", "score",
        F.coalesce("own_licence", "near.licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("near.above")).alias("inherited_from"),
    )


def ancestors(dir_: Column) -> Column:
    """A directory and every one above it, down to the root ''."""
    parts = F.split(dir_, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_union(F.array(F.lit("")), up)
