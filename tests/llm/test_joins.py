import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import licences, linededup, paritysketch, reputation
from weftgraph.llm.paritysketch import Join


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, component_id int")


def near_rows(rng):
    rows = []
    for _ in range(6):
        base = words(rng, rng.randint(5, 220))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows + ["", None, "one", "ONE", "one two", "a b c", "x " * 50]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, k, num):
    rng = random.Random(k)
    texts = near_rows(rng)
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(3, texts[2])]
    got = paritysketch.near_duplicates(frame(spark, [*rows, (None, "one")]), Join(k, num)).collect()
    want = brute.components(rows, k, num)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted(want)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = paritysketch.keep_one(frame(spark, rows), Join(k, num))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _, c in want if i == c}) and kept.columns == ["doc_id", "text", "node", "component_id"]


def test_group_whose_members_do_not_link(spark):
    """Variants of a text that is not there: large buckets, few links; and one chain of links."""
    rng = random.Random(7)
    base = words(rng, 300, 10**6)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(5):
            copy[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    chain = words(rng, 120, 10**6)
    for i in range(12):
        chain = [*chain[:-1], f"c{i}"] if i % 2 else [f"c{i}", *chain[1:]]
        rows.append((500 + i, " ".join(chain)))
    got = paritysketch.near_duplicates(frame(spark, rows), Join(3, 90)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.components(rows, 3, 90))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
        far = len(np.setxor1d(a, b))
        assert (paritysketch.sketch(a, far + 1) != paritysketch.sketch(b, far + 1)).sum() <= far
    for join in (Join(3, 90), Join(5, 80)):
        lows = join.lows()
        for n in (1, 2, 9, 10, 50, 333, 10_000):
            for m in range(n, n * 100 // join.num + 1):
                i = int(np.searchsorted(lows, n, "right")) - 1
                j = int(np.searchsorted(lows, m, "right")) - 1
                assert j - i in (0, 1)
                if (n + m) * (100 - join.num) // (100 + join.num):
                    parts, slack = join.parts(lows, i)
                    assert parts - slack > (n + m) * (100 - join.num) // (100 + join.num)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert paritysketch.near_duplicates(none).count() == 0 and paritysketch.keep_one(none).count() == 0
    assert linededup.dropped_by_document(none).count() == 0 and linededup.remove_lines(none).count() == 0


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 1)
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    x, y = F.col("x"), F.col("y")
    for k in (1, 2, 3):
        for r in df.select("x", "y", linededup.trimmed_distance(x, y, k).alias("d"), linededup.pieces_near(x, y, k).alias("p"), linededup.sketches(x).alias("s"), linededup.sketches(y).alias("t")).collect():
            far = brute.distance(r["x"], r["y"])
            assert min(r["d"], k + 1) == min(far, k + 1), (k, r)
            if far <= k:
                bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
                assert bits(r["s"]["one"], r["t"]["one"]) <= 2 * k and bits(r["s"]["two"], r["t"]["two"]) <= 4 * k
                assert len(r["x"]) < 3 * k or r["p"] >= 2 * k


def line_rows(rng):
    bases = [" ".join(words(rng, rng.randint(4, 12))) for _ in range(8)]
    texts = []
    for _ in range(25):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice("xé9")] * rng.randint(0, 1)
            lines.append("".join(line))
        texts.append("\n".join(lines))
    return [*texts, "", None, "short\nshort", "\n\n", "a line of some length\na line of some length"]


@pytest.mark.parametrize("k", [1, 2])
def test_lines_against_brute_force(spark, k):
    rows = [(i, t) for i, t in enumerate(line_rows(random.Random(k)))] + [(None, "a line of some length")]
    got = {r["doc_id"]: r for r in linededup.dropped_by_document(frame(spark, rows), k).collect()}
    want = brute.dropped_lines(rows, k)
    for i, t in rows:
        assert list(got[i]["dropped"]) == want.get(i, []) and got[i]["n_dropped"] == len(want.get(i, [])) and got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
    left = {r["doc_id"]: r["text"] for r in linededup.remove_lines(frame(spark, rows), k).collect()}
    for i, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(i, [])))


def test_hot_segments(spark, monkeypatch):
    """Many different lines share a segment; with a low limit they take the other way."""
    monkeypatch.setattr(linededup, "HOT", 2)
    monkeypatch.setattr(linededup, "SAMPLE", 1)
    rng = random.Random(11)
    stem = "the same beginning of every line in this test, which is long enough "
    rows = [(i, stem + "".join(rng.choice("ab") for _ in range(7))) for i in range(60)]
    got = {r["doc_id"]: list(r["dropped"]) for r in linededup.dropped_by_document(frame(spark, rows)).collect()}
    want = brute.dropped_lines(rows)
    assert got == {i: want.get(i, []) for i, _ in rows}


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_rules_and_hosts(spark):
    urls = ["http://A.example.NET/en/x?q#f", "https://example.net/de", "x://example.com/de/1", "http://notexample.com/de/", "ftp://a.org/fr/", "nothing", None, "http://h?q=/net/", "http://sub.co.uk#x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in reputation.judge(pages, none, RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/", None, "allow"), ("a.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("sub.co.uk", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert reputation.judge(pages.limit(0), none, RULES).count() == 0
    with pytest.raises(ValueError):
        reputation.judge(pages, none, RULES * 200)


def test_reputation_shrinks(spark):
    urls = [f"http://bad.farm.com/{i}" for i in range(60)] + [f"http://good.site.com/{i}" for i in range(60)] + ["http://new.farm.com/", "http://one.site.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 120)] + [(121, 1)], "page_id long, bad int")
    got = {r["host"]: r for r in reputation.judge(pages, outcomes, []).collect()}
    assert got["bad.farm.com"]["verdict"] == "block" and got["good.site.com"]["verdict"] == "allow"
    assert got["good.site.com"]["bad_share"] < got["one.site.com"]["bad_share"] < got["bad.farm.com"]["bad_share"]
    assert got["good.site.com"]["bad_share"] < got["new.farm.com"]["bad_share"] <= got["bad.farm.com"]["bad_share"]


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", f"{mit}\nmore text", True), (2, "a/b/x.txt", "no header", False), (3, "a/b/y.txt", f"first\n{apache}", False), (4, "z/x.txt", None, False), (5, "x.txt", "", False),
        (6, "a/b/LICENSE", apache.upper(), True), (7, "a/c/d/e.txt", "license", False), (8, None, mit, None), (7, "a/c/d/e.txt", "license", False),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, is_licence_file boolean, licence string")
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.scan(files).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: (None, None, None), 6: ("Apache-2.0", "Apache-2.0", None), 7: (None, "MIT", "a"), 8: ("MIT", "MIT", None)}
    assert licences.scan(files).count() == len(rows) and licences.scan(files.limit(0)).count() == 0
