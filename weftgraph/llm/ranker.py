"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A good document should beat a bad one: the model minimises the logistic loss of
weighted feature differences over pairs of a preferred and a rejected document.
The raw score is then compared with a quantile: the share of rejected labels
among all labelled rows gives the place in the distribution of their scores.

Pairs come from at most per_class labelled ids of each class, drawn by a hash of the
id (the documented bound); rows that repeat an id are one there, with the smallest of
their texts. The share and the quantile cover all labelled rows.

Defined cases: null texts score like empty ones; without rows of both classes
every score is 0.7 (nothing is rejected); repeated rows are scored one by one, and
count one by one in the quantile. Equal raw scores have equal scores, so rows that
tie at the threshold all stay. Very long texts are scored whole. Empty tables give no
rows; columns besides the named ones are not read, keep() returns them as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded, byte_texts, hash_filter, map_arrow, maybe_in, pick

CUT = 0.7
#: The threshold lies midway between the quantiles this share below and above the share of rejected labels.
SIDE = 0.01
NAMES = (
    "log_chars", "upper", "symbol", "pipe", "bang", "digit", "space", "sentence_marks", "comma", "line_breaks", "mark_words", "unique_words",
    "next_same", "unique_pairs", "packed", "word_len", "long_words", "capital_words", "high_bytes", "empty",
)
UPPER = bytes(range(65, 91))
SYMBOL, PIPE, BANG, DIGIT, STOP, COMMA = b"#*$%&<>~^=_\\{}[]", b"|", b"!", b"0123456789", b".?;:", b","


def features(text: bytes | None) -> list[float]:
    """Features of a whole text, each of bounded size; see NAMES."""
    text = text or b""
    n = len(text)
    ws = text.split()
    if not ws:
        return [0.0] * (len(NAMES) - 1) + [1.0]

    def share(chars: bytes) -> float:
        return 1 - len(text.translate(None, chars)) / n

    k = len(ws)
    pairs = set(zip(ws, ws[1:]))
    marked = sum(not w[-1:].isalnum() and w[-1] < 0x80 and w[-1:] not in b".,;:?" for w in ws) / k
    length = sum(map(len, ws)) / k
    return [
        np.log1p(n) / 10, share(UPPER), share(SYMBOL), share(PIPE), share(BANG), share(DIGIT), share(b" "), share(STOP), share(COMMA), min(1.0, 40 * share(b"\n")), marked,
        len(set(ws)) / k ** 0.9, sum(a == b for a, b in zip(ws, ws[1:])) / k, len(pairs) / k, min(1.5, len(zlib.compress(text, 1)) / n), min(length, 40) / 10,
        sum(len(w) > 24 for w in ws) / k, sum(65 <= w[0] <= 90 for w in ws) / k, 1 - len(text.translate(None, bytes(range(128, 256)))) / n, 0.0,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Newton steps on the pairwise logistic loss; every row occurs in some pair."""
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    n = max(pairs, len(good), len(bad))
    g, b = np.resize(rng.permutation(len(good)), n), rng.permutation(np.resize(np.arange(len(bad)), n))
    z = lambda x: np.clip((x - mean) / scale, -6, 6)
    d = z(good[g]) - z(bad[b])
    w = np.zeros(d.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * w - d.T @ p / n
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(1e-9, np.linalg.norm(step)))
    return Model(mean, scale, w)


def _matrix(rows) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f8").reshape(len(rows), len(NAMES))


@dataclass
class Judge:
    """A model and the raw score at which score is CUT; without a model everything scores CUT."""

    model: Model | None
    at: float = 0.0

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.model is None:
            return np.zeros(len(x)), np.full(len(x), CUT)
        raw = self.model.raw(x)
        return raw, 1 / (1 + np.exp(-np.clip(raw - self.at + np.log(CUT / (1 - CUT)), -500, 500)))


def _features_of(column: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in byte_texts(column)]).reshape(len(column), len(NAMES))


def learn(docs: DataFrame, labels: DataFrame, trainable, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Judge:
    """Fit the model on pairs and find the quantile over all labelled rows.

    trainable(column) tells from the id which rows labels may be learned from.
    labels has doc_id and label_col (1 preferred, 0 rejected, null unknown); an id
    labelled both ways takes the smaller label.
    """
    one = pick(docs, id_col, text_col).toDF("doc_id", "text")
    known = (
        pick(labels, "doc_id", label_col).toDF("doc_id", "y").where(trainable(F.col("doc_id")) & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Judge(None)
    part = {y: int(min(1.0, per_class / n) * 1e6) for y, n in counts.items()}
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("rank")), F.lit(1_000_000))
    sample = bounded(known.where(drawn < F.when(F.col("y") == 1, part[1]).otherwise(part[0])), 4 * per_class + 1000)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [row.astype("<f8").tobytes() for row in _features_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary())], names=["y", "x"])

    got = sorted(map_arrow(one.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text"), vectors, "y int, x binary").collect(), key=lambda r: bytes(r["x"]))
    good, bad = [r for r in got if r["y"] == 1], [r for r in got if r["y"] == 0]
    if not good or not bad:
        return Judge(None)
    model = fit(_matrix(good), _matrix(bad))

    def raw(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.raw(_features_of(batch.column(1))), pa.float64())], names=["doc_id", "raw"])

    share = counts[0] / (counts[0] + counts[1])
    around = [share * (1 - SIDE), min(1.0, share * (1 + SIDE))]
    # Only rows that may be labelled are scored here; the join is exact.
    hashed = maybe_in(one.withColumn("id_hash", F.xxhash64("doc_id")), "id_hash", hash_filter(known.select(F.xxhash64("doc_id").alias("h"))), "labelled")
    ends = map_arrow(hashed.where("labelled").select("doc_id", "text"), raw, "doc_id bigint, raw double").join(known, "doc_id").agg(F.percentile_approx("raw", around, 20_000)).first()[0]
    return Judge(model, sum(ends) / 2 if ends else 0.0)


def score(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw, score of every whole text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, scores = judge.scores(_features_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "raw", "score"])

    return map_arrow(pick(docs, id_col, text_col), one, "doc_id bigint, raw double, score double")


def keep(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """The rows of docs that score CUT or more, with all their columns."""
    place = docs.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge.scores(_features_of(batch.column(place)))[1] >= CUT))

    return map_arrow(docs, one, docs.schema)
