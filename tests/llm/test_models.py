"""Learned operators against plain versions: voting, pairwise fit, lexicon matching, bands."""

import math
import random
from collections import defaultdict

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weftgraph.llm import langid, quality, ranker, toxicity
from weftgraph.llm.common import held_out

DATA = "/root/testdata/sf0.001"
ODD = ["", None, "½ ² ⅷ", "12 !?", "a", "e" * 50_000, "\n\n", "ж" * 400]


def frame(spark, texts):
    rows = [(i, t, "x", 1.0, 7) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, __id_hash int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_vote(model, text):
    """Family by the greatest margin, then a vote of every pair, in plain loops."""
    if not text or not any(c.isalpha() for c in text):
        return "und", None
    data = b" " + b" ".join(bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
    counts = defaultdict(int)
    bits, mask = langid.DIM.bit_length() - 1, 0xFFFFFFFF
    for a, b in zip(data, data[1:]):
        counts[((a * 257 + b) * 0xC2B2AE35 & mask) >> (32 - bits)] += 1
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a * 257 + b) * 0x9E3779B1 + c * 0x85EBCA6B & mask) >> (32 - bits)] += 1
    norm = math.sqrt(sum(counts.values()))
    margin = lambda w: sum(float(w[i]) * math.sqrt(n) / norm for i, n in counts.items()) + float(w[-1])
    family = max(model.families, key=lambda f: (margin(model.family_w[model.families.index(f)]), f)) if len(model.families) > 1 else model.families[0]
    langs, votes = model.members[family], defaultdict(float)
    for (a, b), w in zip(model.pairs[family], model.pair_w[family], strict=True):
        m = margin(w)
        votes[a if m >= 0 else b] += 1
        votes[a] += 1e-3 * math.tanh(m)
        votes[b] -= 1e-3 * math.tanh(m)
    return langs[max(range(len(langs)), key=lambda i: (votes[i], -i))], family


def test_language_votes(spark, docs):
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ODD
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["lang_pred"], got[i]["family_pred"]) == plain_vote(model, t), t and t[:40]
    assert [got[i]["lang_pred"] for i, t in enumerate(texts) if t in ("½ ² ⅷ", "12 !?", "", None, "\n\n")] == ["und"] * 5


def test_language_machine_is_at_its_optimum():
    """No small step lowers the squared hinge loss of the trained machine by much."""
    rng = np.random.default_rng(3)
    y = np.where(np.arange(120) % 2, 1, -1)
    x = (rng.normal(size=(120, 12)) + 0.4 * y[:, None]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = 10.0
    scaled = np.hstack([x, np.full((120, 1), 0.3)])
    loss = lambda w: 0.5 * float(w @ w) + c * float((np.maximum(0, 1 - y * (scaled @ w)) ** 2).sum())
    w = langid.train_svm(x, y, c, rounds=60).astype(float)
    w[-1] /= 0.3
    plain = np.zeros(13)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (scaled @ plain))
        plain -= 1e-3 * (plain - 2 * c * scaled.T @ (y * slack))
    assert loss(w) <= 1.01 * loss(plain)


def test_language_ids_that_repeat(spark, docs):
    """A drawn id that occurs very often counts once in training."""
    few = docs.where("lang IN ('en', 'de')").limit(40)
    many = few.unionByName(few.limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n")).drop("n"))
    a, b = langid.train(few), langid.train(many)
    assert a.members == b.members and all(np.allclose(a.pair_w[f], b.pair_w[f]) for f in a.families)


def test_ranking_fit_against_plain_descent():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.4, 1, (40, 5)), rng.normal(-0.4, 1, (30, 5))
    model = ranker.fit(good, bad, pairs=1200)
    z = lambda x: np.clip((x - model.mean) / model.scale, -6, 6)
    d = (z(good)[:, None, :] - z(bad)[None, :, :]).reshape(-1, 5)
    loss = lambda w: float(np.log1p(np.exp(-d @ w)).mean()) + 0.5e-3 * float(w @ w)
    w = np.zeros(5)
    for _ in range(4000):
        p = 1 / (1 + np.exp(d @ w))
        w -= 0.3 * (1e-3 * w - d.T @ p / len(d))
    assert loss(model.weights) <= 1.01 * loss(w) and loss(w) < loss(np.zeros(5))


def test_ranking_threshold_is_the_quantile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judge = ranker.learn(docs, labels, lambda c: ~held_out(c, 4, 2))
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and brute.fold(r["doc_id"], 4) != 2}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known]
    raw = judge.model.raw(np.array([ranker.features((t or "").encode()) for _, t in texts]))
    share = 1 - sum(known.values()) / len(known)
    low, high = np.quantile(raw, [max(0, share - 0.03), min(1, share + 0.03)])
    assert low <= judge.at <= high
    tie = judge.scores(np.array([ranker.features(b"the same text")] * 2))[1]
    assert tie[0] == tie[1]
    assert judge.scores(np.zeros((0, len(ranker.NAMES))))[1].shape == (0,)


def plain_matches(lexicon, folded):
    """Longest pattern at each word's start, without those inside an exception phrase."""
    spared = [(at, at + len(p) + 1) for p in lexicon.exceptions for at in range(len(folded)) if folded.startswith(f" {p} ", at)]
    total, n = 0.0, 0
    for at in range(len(folded)):
        own = [p for p in lexicon.weights if folded.startswith(p, at)]
        if own and not any(a <= at < b for a, b in spared):
            n, total = n + 1, total + lexicon.weights[max(own, key=len)]
    return n, total


def test_toxicity_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.train(docs, labels, lambda c: ~held_out(c, 5, 0))
    lexicon.weights = dict(sorted(lexicon.weights.items())[:40])  # the search below is slow
    lexicon.exceptions += ("stupid question",)
    toxic = [r["doc_id"] for r in labels.where("toxic = 1").collect()][:15]
    texts = [r["text"] for r in docs.where(F.col("doc_id").isin(toxic)).collect()]
    texts = [t[:3000] for t in texts if t] + [*ODD, "a stupid question, you idiot", "put it in the trash can. stupid trash", "idiot " * 30]
    for r in toxicity.score(frame(spark, texts), lexicon).collect():
        n, weight = plain_matches(lexicon, toxicity.fold(texts[r["doc_id"]] or ""))
        assert r["n_matches"] == n and abs(r["weight"] - weight) < 1e-9 and 0 <= r["score"] <= 1


def test_exceptions_are_learned(spark):
    """A word that insults, in a phrase that clean rows have."""
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(12))
    rows = [(i, f"{filler()} you gorblax {filler()}") for i in range(60)] + [(100 + i, f"{filler()} the gorblax harbour {filler()}") for i in range(12)] + [(200 + i, filler()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.Lexicon({" gorblax": 5.0}, ())
    learned = toxicity.learned_exceptions(docs.join(labels, "doc_id").select("text", F.col("toxic").alias("y")), lexicon, (60, 312))
    assert "gorblax harbour" in learned and "you gorblax" not in learned


def test_folding_of_small_capitals_and_mixed_words():
    assert toxicity.fold("1dɪ0t sch31ße héll0 ɪᴅɪᴏᴛ") == " idiot scheiße héllo idiot "


def plain_verdict(text, bands):
    data = (text or "").encode()
    packed = lambda x: len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress(x)) / len(x)

    def outside(n, ratio):
        for start, low, high in sorted(bands.whole, reverse=True):
            if n >= start:
                return ratio < low or ratio > high
        return False

    worst = 0.0
    for size in (bands.chunk_bytes, bands.fine_bytes):
        if len(data) >= size:
            parts = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
            if len(data) % size:
                parts.append(data[-size:])
            ratios = [packed(p) for p in parts]
            bad = [r < bands.chunk[0] or r > bands.chunk[1] if size == bands.chunk_bytes else outside(size, r) for r in ratios]
            worst = max(worst, sum(bad) / len(bad))
    n, _, _, _, repeated = brute.base_counts(text)
    failed = n < 50 or 100 * repeated > 50 * n
    return failed, not failed and not (data and outside(len(data), packed(data))) and worst <= bands.max_bad_chunks


def test_bands_against_a_plain_version(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(120).collect()] + [*ODD, "q " * 60_000, "".join(random.Random(1).choice("abc DEF é\n") for _ in range(9000))]
    for r in quality.judge(frame(spark, texts)).collect():
        assert (r["base_failed"], r["kept"]) == plain_verdict(texts[r["doc_id"]], quality.Bands())
    assert quality.judge(docs.limit(0)).count() == 0
