import random

import brute
import pytest

from weftgraph.llm import paritysketch
from weftgraph.llm.paritysketch import Join


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("num", [99, 100])
def test_high_thresholds(spark, num):
    """Bands beyond 511, and a threshold at which only equal sets link."""
    rng = random.Random(num)
    base = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    near = [*base[:-1], "other"]
    mid = [f"m{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(mid)), (5, " ".join([*mid[:-2], "x", "y"])), (6, "one two"), (7, "ONE two"), (8, "")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in paritysketch.near_duplicates(frame(spark, rows), Join(3, num)).collect())
    assert got == sorted(brute.components(rows, 3, num))


def test_settings():
    for bad in ({"num": 0}, {"num": 101}, {"words": 0}):
        with pytest.raises(ValueError):
            Join(**bad)
    for num in (1, 50, 80, 90, 99, 100):
        join = Join(3, num)
        lows = join.lows()
        assert len(lows) <= paritysketch.PAIR_MASK and all(join.parts(lows, i)[0] >= 0 for i in range(len(lows)))


def test_buckets_of_several_blocks(spark, monkeypatch):
    """Large buckets in blocks of four, with pairs that pass the sketches and fail, and links that they hide."""
    monkeypatch.setattr(paritysketch, "BLOCK", 4)
    monkeypatch.setattr(paritysketch, "SMALL", 2)
    monkeypatch.setattr(paritysketch, "parity_bits", lambda s: __import__("numpy").zeros(8, "uint8"))  # lets every pair pass
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([1, 4, 4, 5])):
            copy[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    got = paritysketch.near_duplicates(frame(spark, rows), Join(3, 90)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.components(rows, 3, 90))


def test_one_worker_for_each_task(spark, monkeypatch):
    """No Python operator reads another's rows inside a task, hot parts included: each would hold a worker of its own."""
    monkeypatch.setattr(paritysketch, "HOT_SAMPLE", 1)
    monkeypatch.setattr(paritysketch, "HOT_COUNT", 2)
    plain, plans = paritysketch.map_arrow, []

    def spied(df, *args):
        plans.append(df._jdf.queryExecution().logical().toString())
        return plain(df, *args)

    monkeypatch.setattr(paritysketch, "map_arrow", spied)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:50], f"x{i}"]) for i in range(6)] + [" ".join(words[::-1]), "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in paritysketch.near_duplicates(docs).collect())
    assert got == [*((i, 0) for i in range(6)), (6, 6), (7, 7)]
    assert plans and not [p for p in plans if "MapInArrow" in p]
