"""Language identification in two levels: the family first, then the language.

Features are byte bigrams and trigrams of the whole lower-cased text, hashed
into DIM buckets; square roots of the counts, scaled to length one. One linear
support vector machine per family (against the rest) picks the family; inside
it, one machine for each pair of languages votes.

Training takes at most per_lang labelled documents of each language, drawn by a
hash of the id (the documented bound); their features are computed on the
executors. Rows that repeat an id and its language are one document there, with the
smallest of their texts, so the bound holds for rows too.

Defined cases: a text that is null or has no letter gives `und` and score 0; signs
that only look like letters, as a half or a Roman numeral sign, are none. With no
labelled row everything is `und`; with one language all others get it. Repeated rows
are judged one by one, ties go to the family and the language first in order. Texts
of any length are judged whole. Empty tables give no rows, and columns besides the
named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import checked_broadcast, map_arrow, pick

DIM = 1 << 13
MAX_LANGS = 512
SCHEMA = "doc_id bigint, lang_pred string, score double, family_pred string"

# Language codes by family. A code outside is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "semitic": "ar he am mt".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "uralic": "fi et hu se".split(),
    "indic": "hi bn mr ne pa gu ur sa".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
FOLD = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Unit vector of hashed byte bigrams and trigrams of a whole text."""
    data = b" " + b" ".join(text.lower().encode().translate(FOLD).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x85EBCA6B)
    counts = np.bincount((two * np.uint32(0xC2B2AE35)) >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    counts = counts + np.bincount(three >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    v = np.sqrt(counts, dtype=np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the bias is the last weight."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    norm = (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * float(w @ x[i]) - 1 + 0.5 * alpha[i] / c) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
    w[-1] *= 0.3
    return w


@dataclass
class Model:
    """families: names and one weight row each; pairs: for each family (a, b) and a row (positive: a)."""

    families: list[str]
    family_w: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_w: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        if not self.families or text is None or not LETTER.search(text):
            return "und", 0.0, None
        v = np.append(features(text), np.float32(1))
        score = 1.0
        if len(self.families) > 1:
            margins = self.family_w @ v
            f = int(np.argmax(margins))
            score = _squash(margins[f])
        else:
            f = 0
        name = self.families[f]
        langs = self.members[name]
        if len(langs) == 1:
            return langs[0], score, name
        votes = np.zeros(len(langs))
        worst = np.full(len(langs), np.inf)
        for (a, b), m in zip(self.pairs[name], self.pair_w[name] @ v, strict=True):
            votes[a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[b] += (m < 0) - 1e-3 * np.tanh(m)
            worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        best = int(np.argmax(votes))
        return langs[best], score * _squash(worst[best]), name


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(max(4 * float(margin), -30), 30))))


def train(labelled: DataFrame, per_lang: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled rows; rows whose text or language is null are left out."""
    rows = pick(labelled, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model([], np.zeros((0, 0)), {}, {}, {})
    share = max(20, min(per_lang, 8 * per_lang // len(counts)))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000))
    part = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(share / n * 1_000_000) if n > share else 1_000_000)])
    sample = rows.where(drawn < part[F.col("lang")]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, value = [], []
        for t in batch.column(0).to_pylist():
            v = features(t)
            i = np.flatnonzero(v)
            at.append(i.astype("<u2").tobytes())
            value.append(v[i].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["lang", "at", "value"])

    got = map_arrow(sample.select("text", "lang"), vectors, "lang string, at binary, value binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return fit(x, [r["lang"] for r in got])


def fit(x: np.ndarray, langs: list[str]) -> Model:
    lang = np.array(langs)
    family = np.array([FAMILY.get(code.lower().split("-")[0], code) for code in langs])
    families = sorted(set(family.tolist()))
    family_w = np.stack([train_svm(x, np.where(family == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((0, x.shape[1] + 1))
    members, pairs, pair_w = {}, {}, {}
    for f in families:
        members[f] = sorted(set(lang[family == f].tolist()))
        pairs[f] = [(a, b) for a in range(len(members[f])) for b in range(a + 1, len(members[f]))]
        rows = []
        for a, b in pairs[f]:
            own = np.isin(lang, [members[f][a], members[f][b]])
            rows.append(train_svm(x[own], np.where(lang[own] == members[f][a], 1, -1)))
        pair_w[f] = np.stack(rows) if rows else np.zeros((0, x.shape[1] + 1))
    return Model(families, family_w, members, pairs, pair_w)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, family_pred of every whole text."""
    shared = checked_broadcast(docs.sparkSession, model, model.family_w.nbytes + sum(w.nbytes for w in model.pair_w.values()), 256 << 20)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.string())],
            names=["doc_id", "lang_pred", "score", "family_pred"],
        )

    return map_arrow(pick(docs, id_col, text_col), one, SCHEMA)
