import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftgraph.llm import decontam, licences, reputation
from weftgraph.llm.bpe import BpeCodec, read_ranks
from weftgraph.llm.licence_texts import TEMPLATES
from weftgraph.llm.queries import VOCAB


def test_suffixes_of_two_labels(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk", "x.github.io", "a.b.com", "com", "", "localhost", "b.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: (r["d"], r["s"]) for r in df.select("h", reputation.domain_of(F.col("h")).alias("d"), reputation.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.github.io": ("x.github.io", "github.io"), "a.b.com": ("b.com", "com"),
        "com": ("com", "com"), "": ("", ""), "localhost": ("localhost", "localhost"), "b.com": ("b.com", "com"),
    }


def plain_posteriors(pages, outcomes, least=0.5, most=1000.0):
    """Host means by the same shrinkage in plain loops; pages: (id, host)."""
    own = defaultdict(list)
    for i, bad in outcomes:
        if i is not None and bad in (0, 1):
            own[i].append(bad)
    hosts = defaultdict(lambda: [0, 0])
    for i, h in pages:
        seen = own.get(i, [])
        hosts[h][0] += len(seen)
        hosts[h][1] += sum(seen)
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in reputation.TWO_LABEL_SUFFIXES else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-(suffix(h).count(".") + 2) :])

    def up(groups, name):
        out = defaultdict(lambda: [0, 0])
        for g, (n, k) in groups.items():
            out[name(g)][0] += n
            out[name(g)][1] += k
        return out

    def shrink(groups, parent):
        plain = {g: n * parent(g) * (1 - parent(g)) for g, (n, k) in groups.items()}
        over = sum((k - n * parent(g)) ** 2 - plain[g] for g, (n, k) in groups.items())
        base = sum(plain[g] * (n - 1) for g, (n, k) in groups.items())
        rho = over / base if base else 0
        a = max(least, min(most, 1 / rho - 1 if rho > 0 else most))
        return {g: (k + a * parent(g)) / (n + a) for g, (n, k) in groups.items()}

    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    n, k = sum(v[0] for v in suffixes.values()), sum(v[1] for v in suffixes.values())
    whole = (k + 1) / (n + 20)
    s = shrink(suffixes, lambda g: whole)
    d = shrink(domains, lambda g: s[suffix(g)])
    return shrink(hosts, lambda g: d[domain(g)])


def test_posteriors_against_plain_loops(spark):
    rng = random.Random(4)
    hosts = [f"{a}.{b}.{s}" for a in "ab" for b in ("x", "y", "z") for s in ("com", "co.uk", "org")] + ["", "solo"]
    pages = [(i if i % 50 else None, rng.choice(hosts)) for i in range(600)]
    outcomes = [(i, rng.choice([0, 0, 1, None]) if "x" not in h else 1) for i, h in pages if rng.random() < 0.8]
    df = spark.createDataFrame([(i, f"http://{h}/p" if h else None, "clash") for i, h in pages], "page_id long, url string, bad string")
    got = reputation.host_posteriors(df, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    want = plain_posteriors(pages, outcomes)
    assert {r["host"] for r in got} == set(want) and all(abs(r["mean"] - want[r["host"]]) < 1e-9 for r in got)


def test_outcomes_of_pages(spark):
    html = ["<p>good text here</p>", "<p>cheap-PILLS now</p>", "alphabets are fine", None, "", "<b>%%% ### $$$ a</b>", "<a href='#####'>plain words in a link</a>", "<i></i>"]
    pages = spark.createDataFrame([(i, h, 3) for i, h in enumerate(html)], "page_id long, html string, bad int")
    assert [r["bad"] for r in reputation.page_outcomes(pages).orderBy("page_id").collect()] == [0, 1, 0, None, 0, 1, 0, 0]


def plain_best(text, vectors, idf, unknown):
    c = Counter(w.lower() for w in re.findall(licences.WORD, text))
    x = {w: (1 + math.log(n)) * idf.get(w, unknown) for w, n in c.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    scores = [(round(sum(x.get(w, 0.0) * v for w, v in vec.items()) / norm, 6), k) for k, vec in vectors]
    top = max(s for s, _ in scores)
    return min(k for s, k in scores if s == top), top


def test_licences_against_every_line(spark):
    """Lines near and far from the templates, compared one by one without the bound."""
    rng = random.Random(8)
    idf, vectors = licences.template_weights(TEMPLATES)
    unknown = math.log(1 + len(vectors)) + 1
    common = sorted(idf, key=lambda w: idf[w])[:60]
    lines = [" ".join(rng.choice(common + ["blorp", "Quux", "zorg"]) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    for texts in TEMPLATES.values():
        for t in texts:
            words = t.split()
            lines += [t.upper(), " ".join(w for w in words if rng.random() < 0.8), " ".join(words + ["blorp"] * (len(words) // 2))]
    lines = [x for x in lines if x]
    files = spark.createDataFrame([(i, f"d{i}/f", x, False, "clash") for i, x in enumerate(lines)], "doc_id long, path string, text string, is_licence_file boolean, segment string")
    got = {r["doc_id"]: (r["own_licence"], r["score"]) for r in licences.scan(files).collect()}
    n_found = 0
    for i, x in enumerate(lines):
        best = [plain_best(y, vectors, idf, unknown) for y in x.split("\n")]
        name, score = min(best, key=lambda b: (-b[1], b[0]))
        want = (name, score) if score >= licences.THRESHOLD else (None, None)
        n_found += want[0] is not None
        assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 2e-6), (x, got[i], want)
    assert n_found > 60


def test_licence_files_and_spdx_lines(spark):
    mit = "MIT License\n\nCopyright (c) 2024 Someone\n\n" + TEMPLATES["MIT"][0].replace(". ", ".\n\n")
    bsd = "Copyright (c) 2019, Someone Else\nAll rights are theirs.\n\n" + TEMPLATES["BSD-3-Clause"][0].replace("; ", ";\n")
    texts = [mit, bsd, "// SPDX-License-Identifier: GPL-3.0-or-later\nint main;", "# SPDX-License-Identifier: MIT", "All rights reserved.", "nothing of the kind\nin two lines", "the of and to in a " * 400, None, ""]
    files = spark.createDataFrame([(i, f"p{i}/LICENSE", t, i < 2) for i, t in enumerate(texts)], "doc_id long, path string, text string, is_licence_file boolean")
    got = {r["doc_id"]: r for r in licences.scan(files).collect()}
    assert [got[i]["own_licence"] for i in range(9)] == ["MIT", "BSD-3-Clause", "GPL-3.0", "MIT", "Proprietary", None, None, None, None]
    assert got[1]["score"] < 1.0 and licences.scan(files.limit(0)).count() == 0


def test_suffix_array_order():
    rng = random.Random(6)
    import numpy as np

    for bits, per_key in ((3, 2), (3, 1), (8, 7)):
        stream = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(400)] + [1, 2] * 40, np.int64)
        depth = 30
        own = decontam.SuffixArray(stream, bits, per_key, depth)
        words = lambda p: tuple(stream[p : p + depth].tolist())[: next((i for i, w in enumerate(stream[p : p + depth].tolist()) if w == 0), depth)]  # noqa: E731, B023
        keys = [words(p) for p in own.array.tolist()]
        assert sorted(own.array.tolist()) == np.flatnonzero(stream).tolist() and keys == sorted(keys)


def test_real_texts_are_joined_up_the_tree(spark):
    """Matches of the test documents go through joins, and their windows are encoded anew."""
    import public_tokenizers

    codec = BpeCodec(read_ranks(public_tokenizers.path(VOCAB)), public_tokenizers.PATTERN)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    for t in texts:
        codec.encode(t)
    assert codec.joins > 1000 and codec.windows > 1000


def test_text_longer_than_a_shard(spark, monkeypatch):
    import brute

    monkeypatch.setattr(decontam, "SHARD_BYTES", 500)
    item = "one two three four five six seven eight nine"
    texts = ["x y " * 400 + item + " z" * 300, item, "x " * 90]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, item, 0)], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.find_matches(docs, bench).collect()}
    assert got == {i: (n, h) for i, n, h, _ in brute.hits(list(enumerate(texts)), [(1, item)])}
