"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
digits or signs that stand for letters become plain letters, everything else
becomes a space. Patterns are words or word stems anchored at a word's start.
Their weights are smoothed log odds between toxic and other labelled rows. The
sum of the weights of the longest match at each word, without matches inside an
exception phrase, is normalised by length and mapped to 0..1 by a logistic fit.
Exceptions are built in, and learned: pairs of neighbouring words with a match that
clean rows have and toxic rows hardly.

Training takes at most per_class labelled ids of each class, drawn by a hash of the
id (the documented bound); rows that repeat an id are one there, with the smallest of
their texts. The size of the model is bounded by parameters: a pattern needs
min_support of the toxic rows, and the max_candidates most frequent ones are looked
at, of which max_patterns are kept. Every text is matched whole.

Defined cases: null and empty texts have no match and get the score of a clean
text. Without labelled rows of both classes the built-in words weigh DEFAULT. Of
matches that begin at one word the longest counts, of patterns with equal support the
first in order comes first. Repeated rows are judged one by one. Empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded, checked_broadcast, map_arrow, pick

DEFAULT = 6.0
SCHEMA = "doc_id bigint, score double, n_matches bigint, weight double"

# English words that insult, with or without labels.
WORDS = "idiot moron loser scum pathetic worthless disgusting stupid trash clown imbecile bastard".split()
# Phrases in which a word of the lexicon does no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "pond scum", "sore loser")
# Signs and letters of other scripts that stand for a Latin letter.
SUBSTITUTES = {
    "a": "4@аαɑᴀ", "b": "8ьβʙ", "c": "сϲᴄ", "d": "ԁᴅ", "e": "3еεҽᴇ", "f": "ꜰ", "g": "9ɡɢ", "h": "һʜ", "i": "1!іιıɪ", "j": "јᴊ", "k": "кκᴋ", "l": "ӏʟ", "m": "мᴍ",
    "n": "ոɴ", "o": "0оοσᴏ", "p": "рρᴘ", "q": "ԛ", "r": "ʀ", "s": "5$ѕꜱ", "t": "7тτᴛ", "u": "υսᴜ", "v": "ѵνᴠ", "w": "ԝᴡ", "x": "хχ", "y": "уүʏ", "z": "ᴢ",
}
MIN_STEM, MAX_STEM = 4, 8


class _Fold(dict):
    """Table for str.translate(), filled as characters turn up.

    Inside a word digits and signs are letters, elsewhere they are spaces.
    """

    def __init__(self, inside: bool):
        self.inside = inside

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if not self.inside and char.isascii() and not char.isalpha():
            self[code] = " "
            return " "
        plain = next((k for k, v in SUBSTITUTES.items() if char in v), None)
        if plain is None:
            base = unicodedata.normalize("NFKC", char).lower()
            plain = base if base.isalpha() else next((k for k, v in SUBSTITUTES.items() if base and base in v), "" if unicodedata.combining(char) else " ")
        self[code] = plain
        return plain


_FOLD, _WORD = _Fold(False), _Fold(True)


def fold(text: str) -> str:
    """Lower-case words of plain letters, each between single spaces.

    A digit or sign counts as a letter only inside a word that has a letter, and
    a final `!` or `$` does not.
    """
    if not text:
        return " "
    low = text.lower()
    if not low.isascii() or _MIXED.search(low):
        low = _MIXED.sub(lambda m: _as_letters(m.group()), low)
    return " " + " ".join(low.translate(_FOLD if not low.isascii() else _PLAIN).split()) + " "


_MIXED = re.compile(r"[^\W\d_]+[0-9@$!](?:[^\W_]|[@$!])*|[0-9@$!]+[^\W\d_](?:[^\W_]|[@$!])*")
_PLAIN = {c: chr(c) if chr(c).isalpha() else " " for c in range(128)}


def _as_letters(word: str) -> str:
    body = word.rstrip("!$")
    return "".join(_WORD[ord(c)] for c in body) + " " * (len(word) - len(body))


@dataclass
class Lexicon:
    """Patterns begin with a space; (bias, slopes) map the two length features to a log odds."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slopes: tuple[float, float] = (1.0, 1.0)

    def automaton(self):
        auto = ahocorasick.Automaton()
        for p, w in self.weights.items():
            auto.add_word(p, (len(p), w))
        for p in self.exceptions:
            auto.add_word(f" {p}", (len(p) + 1, None))
        auto.make_automaton()
        return auto

    def odds(self, weight: float, n_words: int) -> float:
        x = self.lengths(weight, n_words)
        return self.bias + self.slopes[0] * x[0] + self.slopes[1] * x[1]

    @staticmethod
    def lengths(weight: float, n_words: int) -> tuple[float, float]:
        return math.log1p(max(weight, 0.0)), math.log1p(100.0 * max(weight, 0.0) / (n_words + 10.0))


def matches(auto, folded: str) -> tuple[int, float]:
    """Number and weight of the matches: one at each word start, none in an exception."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, w) in auto.iter(folded) if len(auto) else ():
        start = end - size + 1
        if w is None:
            if folded[end + 1 : end + 2] == " ":
                spared.append((start, end))
        elif start not in best or size > best[start][0]:
            best[start] = (size, w)
    if spared:
        best = {s: v for s, v in best.items() if not any(a <= s <= b for a, b in spared)}
    return len(best), sum(w for _, w in best.values())


def stems(folded: str) -> set[str]:
    """Words of a folded text and their stems, each after a space; whole words end with one."""
    out = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 40:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1))
    return out


def train(docs: DataFrame, labels: DataFrame, trainable, per_class: int = 3000, max_patterns: int = 2000, min_support: float = 0.004, max_candidates: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn patterns, weights and the logistic map from labelled rows.

    trainable(column) tells from the id which rows labels may be learned from.
    """
    builtin = Lexicon({f" {w}": DEFAULT for w in WORDS})
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text").where("text IS NOT NULL")
    known = (
        pick(labels, "doc_id", label_col).toDF("doc_id", "y").where(trainable(F.col("doc_id")) & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return builtin
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1_000_000))
    part = {y: int(min(1.0, per_class / n) * 1e6) for y, n in counts.items()}
    chosen_ids = bounded(known.where(drawn < F.when(F.col("y") == 1, part[1]).otherwise(part[0])), 4 * per_class + 1000)
    sample = texts.join(chosen_ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = [Counter(), Counter()]
        rows = [0, 0]
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(stems(fold(t)))
            rows[y] += 1
        seen[0][""], seen[1][""] = rows
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["p", "hit", "miss"])

    table = map_arrow(sample.select("text", F.col("y").cast("int")), count, "p string, hit bigint, miss bigint").groupBy("p").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    least = F.greatest(F.lit(4), F.lit(part[1] / 1e6 * counts[1] * min_support))
    # Patterns that occur at least eight times as often in toxic rows; the most frequent come first.
    got = table.where((F.col("p") == "") | ((F.col("hit") >= least) & (F.col("hit") >= 8 * (F.col("miss") * part[1] * counts[1] / (part[0] * counts[0]))))).orderBy(F.desc("hit"), F.desc("miss"), "p").limit(max_candidates).collect()
    total = next(((r["hit"], r["miss"]) for r in got if r["p"] == ""), (0, 0))
    found = {r["p"]: (r["hit"], r["miss"]) for r in got if r["p"]}
    chosen = choose(found, total, max_patterns)
    lexicon = Lexicon({f" {w}": DEFAULT for w in WORDS} | chosen)
    lexicon.exceptions = EXCEPTIONS + learned_exceptions(sample, lexicon, total)
    auto = checked_broadcast(docs.sparkSession, lexicon, 100 * len(lexicon.weights))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = auto.value.automaton()
        got = [(matches(a, f := fold(t))[1], f.count(" ") - 1) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["y", "weight", "n"])

    rows = map_arrow(sample.select("text", F.col("y").cast("int")), measure, "y int, weight double, n bigint").collect()
    lexicon.bias, lexicon.slopes = calibrate(sorted((r["y"], r["weight"], r["n"]) for r in rows), counts)
    return lexicon


def phrases(auto, folded: str) -> set[str]:
    """Pairs of neighbouring words, one of which begins with a pattern."""
    words = folded.split()
    hit = [any(True for end, (size, _) in auto.iter(f" {w} ") if end - size + 1 == 0) for w in words]
    return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}


def learned_exceptions(sample: DataFrame, lexicon: Lexicon, total: tuple[int, int], least: int = 5, most: int = 500) -> tuple[str, ...]:
    """Phrases with a match that at least `least` clean rows have, and toxic rows at a twentieth of that rate or less."""
    shared = checked_broadcast(sample.sparkSession, lexicon.weights, 100 * len(lexicon.weights))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = Lexicon(shared.value, ()).automaton()
        seen = [Counter(), Counter()]
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(phrases(auto, fold(t)))
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["p", "hit", "miss"])

    table = map_arrow(sample.select("text", F.col("y").cast("int")), count, "p string, hit bigint, miss bigint").groupBy("p").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    clean = (F.col("miss") >= least) & (F.col("hit") * (20 * (total[1] + 1)) <= F.col("miss") * (total[0] + 1))
    return tuple(r["p"] for r in table.where(clean).orderBy(F.desc("miss"), "p").limit(most).collect() if r["p"] not in EXCEPTIONS)


def choose(found: dict[str, tuple[int, int]], total: tuple[int, int], max_patterns: int) -> dict[str, float]:
    """The shortest pure stems, each drawn out as far as its support stays the same."""
    def weight(p: str) -> float:
        hit, miss = found[p]
        return math.log((hit + 0.5) / (total[0] + 1)) - math.log((miss + 0.5) / (total[1] + 1))

    def pure(p: str) -> bool:
        hit, miss = found[p]
        return miss * (total[0] + 1) <= 0.03 * hit * (total[1] + 1) and weight(p) >= 3

    kept: dict[str, float] = {}
    longer: dict[str, str] = {}
    for p in sorted(found, key=lambda p: (-found[p][0], p)):
        stem = p[:-1] if len(p) > 2 else ""
        if stem in found and stem not in longer and found[p][0] >= 0.98 * found[stem][0]:
            longer[stem] = p
    for p in sorted(found, key=lambda p: (len(p), p)):
        if not pure(p) or any(p[:n] in kept for n in range(2, len(p))):
            continue
        while p in longer and pure(longer[p]):
            p = longer[p]
        kept[p] = weight(p)
    return dict(sorted(kept.items(), key=lambda kv: (-found[kv[0]][0], kv[0]))[:max_patterns])


def calibrate(rows: list[tuple[int, float, int]], counts: dict[int, int]) -> tuple[float, tuple[float, float]]:
    """Logistic regression of the label on the two length features; classes weigh as often as they occur."""
    x = np.array([[1.0, *Lexicon.lengths(w, n)] for _, w, n in rows])
    y = np.array([r[0] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return -3.0, (1.0, 1.0)
    n = counts[0] + counts[1]
    share = np.where(y == 1, counts[1] / n / y.sum(), counts[0] / n / (1 - y).sum())
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + 1e-4 * w * [0, 1, 1]
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-4, 1e-4])
        w -= np.clip(np.linalg.solve(hessian, gradient), -3, 3)
    return float(w[0]), (float(w[1]), float(w[2]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_matches, weight of every whole text."""
    shared = checked_broadcast(docs.sparkSession, lexicon, 100 * len(lexicon.weights))
    holder: dict = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lex = shared.value
        auto = holder.get("auto") or holder.setdefault("auto", lex.automaton())
        scores, numbers, weights = [], [], []
        for t in batch.column(1).to_pylist():
            folded = fold(t or "")
            n, w = matches(auto, folded)
            scores.append(1 / (1 + math.exp(-min(max(lex.odds(w, folded.count(" ") - 1), -30), 30))))
            numbers.append(n)
            weights.append(w)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(weights, pa.float64())],
            names=["doc_id", "score", "n_matches", "weight"],
        )

    return map_arrow(pick(docs, id_col, text_col), one, SCHEMA)
