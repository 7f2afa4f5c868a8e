import gc
import hashlib
import random
import struct
import weakref

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, langid, quality, ranker, toxicity
from weftgraph.llm.bpe import BpeCodec, read_ranks, safe_chunks, tree_fold
from weftgraph.llm.common import held_out, without_ids
from weftgraph.llm.queries import QUERIES, VOCAB

DATA = "/root/testdata/sf0.001"
ODD = ["", "a", None, "x" * 3000, "ab" * 900, "\n\n \t ", "é" * 700, "😀" * 90, "don't 12 ab12!? " * 40, "a\u00a0b\u2003c", "  lead", "trail  \n", "0" * 500]


def frame(spark, texts, **more):
    """Rows with repeated ids, and columns that clash with results."""
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words double")


@pytest.fixture(scope="module")
def codec():
    return BpeCodec(read_ranks(public_tokenizers.path(VOCAB)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = read_ranks(public_tokenizers.path(VOCAB))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 7, 48])
def test_encoding_equals_the_library(codec, reference, leaf):
    own = BpeCodec(codec.ranks, public_tokenizers.PATTERN, leaf)
    rng = random.Random(leaf)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aeiorst nE\u00e9\u4e2d 1!\n") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["".join(rng.choice("aeionrst") for _ in range(5000)), " ".join("abc" for _ in range(30_000))]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_join_is_associative(codec):
    rng = random.Random(2)
    for _ in range(200):
        data = "".join(rng.choice("aeinrt") for _ in range(rng.randint(2, 60))).encode()
        i, j = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        a, b, c = codec.merge(data[:i]), codec.merge(data[i:j]), codec.merge(data[j:])
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.merge(data)


def test_chunks_and_folds():
    text = "ab  c de\nf " * 50
    assert "".join(safe_chunks(text, 7)) == text and safe_chunks("", 7) == []
    assert tree_fold(list("abcde"), str.__add__, "") == "abcde" and tree_fold([], str.__add__, "") == ""


def test_encode_documents(spark, reference):
    got = bpe.token_digests(bpe.encode_documents(frame(spark, ODD), public_tokenizers.path(VOCAB), public_tokenizers.PATTERN)).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, ODD).limit(0), public_tokenizers.path(VOCAB), public_tokenizers.PATTERN).count() == 0


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [*ODD, *[" ".join(rng.choice(["a", "bé", "#c", "d\n", "\td*"]) for _ in range(rng.randint(1, 60))) for _ in range(20)], "same line here\n" * 40, "a b c " * 100]
    got = quality.judge(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute.base_counts(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_compression_bands(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400))
    noise = " ".join("".join(chr(rng.randrange(33, 0x3000)) for _ in range(9)) for _ in range(300))
    words = [f"w{i}" for i in range(60)]
    loop = " ".join(words) + " " + " ".join("z" * i for i in range(900))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, [prose, noise, loop])).collect()}
    assert got[0] and not got[1] and not got[2]


def test_chunks_cover_the_whole_text(spark):
    """Unreadable tails are judged, also in texts below 4096 bytes."""
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(1200))
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2900))
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, [prose[:4096] + code, prose[:2000] + code[:1500], prose[:4096] + prose[4096:5000], prose[:3500]])).collect()}
    assert [got[i]["kept"] for i in range(4)] == [False, False, True, True]
    assert got[0]["bad_chunks"] > 0.34 and not any(r["base_failed"] for r in got.values())
    text = bytes(range(256)) * 5
    assert quality.chunks(text, 1024) == [text[:1024], text[256:]] and quality.chunks(text[:1024], 1024) == [text[:1024]] and quality.chunks(text, 4096) == []


def test_more_blocks_than_one_plan_holds(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 3)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}") for i in range(12)]
    texts = [*ODD, items[0][1], items[7][1] + " x " + items[11][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: (n, h, len(f)) for i, n, h, f in brute.hits(list(enumerate(texts)), items)}
    got = decontam.item_digests(decontam.find_matches(frame(spark, texts), bench, block_bytes=75)).collect()
    assert len(got) == len(texts) + 1 and all((r["n_words"], r["n_hit"], r["n_items"]) == want[r["doc_id"]] for r in got)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    words = ["ab", "Cd", "é", "x1", "zz"]
    items = [(1, "one two three four five six seven eight nine"), (2, "ab ab"), (3, None), (4, "!!"), (5, "Uno dos; tres"), (5, "ab ab ab")]
    items += [(10 + i, " ".join(rng.choice(words) for _ in range(12))) for i in range(5)]
    texts = [*ODD, "ONE two, three four five six seven eight nine ten", "one two three four five six seven", "uno DOS tres ab ab ab-ab"]
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_matches(frame(spark, texts), bench)
    want = {i: (n, h, hashlib.sha256(",".join(f).encode()).hexdigest(), len(f)) for i, n, h, f in brute.hits(list(enumerate(texts)), items)}
    for block in (8 << 20, 60):
        got = decontam.item_digests(decontam.find_matches(frame(spark, texts), bench, block_bytes=block)).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert (r["n_words"], r["n_hit"], r["items_sha256"], r["n_items"]) == want[r["doc_id"]] and r["contaminated"] == (r["n_items"] >= 2)
    long = {(r["doc_id"], m["item_id"]): m for r in found.collect() for m in r["matches"]}
    assert long[len(ODD), 1]["n_words"] == 9 and long[len(ODD), 1]["doc_start"] == 0
    kept = decontam.decontaminate(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([0] + [i for i in want if want[i][3] < 2]) and kept.columns == ["doc_id", "text", "score", "n_words"]
    none = decontam.item_digests(decontam.find_matches(frame(spark, texts), bench.limit(0)))
    assert none.where("n_hit > 0 OR n_items > 0").isEmpty()


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = QUERIES["op1_language"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    own = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert own[0] > 0.95 and 0 <= own[1] <= own[2] <= 1
    model = langid.train(docs)
    got = [r["lang_pred"] for r in langid.predict(frame(spark, ["12 !?", None, ""]), model).orderBy("doc_id").collect()]
    assert got == ["und"] * 4
    empty = langid.train(docs.limit(0))
    assert langid.predict(frame(spark, ["abc"]), empty).first()["lang_pred"] == "und"
    one = langid.train(docs.where("lang = 'de'"))
    assert langid.predict(frame(spark, ["abc"]), one).first()["lang_pred"] == "de"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_ranking_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = QUERIES["op3_quality_ranking"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    docs = frame(spark, ODD)
    nothing = ranker.learn(docs, labels.limit(0), lambda c: F.lit(True))
    got = ranker.score(docs, nothing).collect()
    assert len(got) == len(ODD) + 1 and all(r["score"] == ranker.CUT for r in got) and ranker.keep(docs, nothing).columns == docs.columns
    real = ranker.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, lambda c: ~held_out(c, 4, 2))
    assert all(0 <= r["score"] <= 1 for r in ranker.score(docs, real).collect()) and ranker.score(docs.limit(0), real).count() == 0


def test_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).first()[0] > 0.9
    lexicon = toxicity.train(docs, labels, lambda c: ~held_out(c, 5, 0))
    texts = ["you are a stupid idiot", "you are a 5tup1d 1diot!", "you are a ѕtupіd іdіоt", "put it in the trash can", "a quiet day", "", None]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, texts), lexicon).collect()}
    assert got[0]["n_matches"] == got[1]["n_matches"] == got[2]["n_matches"] == 2 and got[3]["n_matches"] == 0
    assert all(got[i]["score"] >= 0.5 for i in range(3)) and all(got[i]["score"] < 0.5 for i in range(3, 7))
    plain = toxicity.train(docs, labels.limit(0), lambda c: F.lit(True))
    assert " stupid" in plain.weights and toxicity.score(docs.limit(0), plain).count() == 0


def test_folding():
    assert toxicity.fold("Ｓtüpid 1d10t 2024 $5!") == " stüpid idiot "
    assert toxicity.fold("") == " "


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id long, `x.y` string")
    left = lambda ids: sorted((r[0] is None, r[0] or 0) for r in without_ids(docs, "doc_id", spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert left([2]) == [(False, 1), (True, 0)] and left([None]) == [(False, 1), (False, 2), (False, 2)] and len(left([])) == 4


def test_codec_leaves_nothing_behind(codec):
    """A closed codec is freed without the collector of cycles."""
    gc.collect()
    gc.disable()
    try:
        own = BpeCodec(codec.ranks, public_tokenizers.PATTERN)
        own.encode("what an unusuallyy longish wordd it iss " * 3)
        gone = weakref.ref(own)
        own.close()
        del own
        assert gone() is None
    finally:
        gc.enable()


def test_caches_of_any_size(spark, reference):
    texts = [" ".join(f"wo{i * j % 97}rd{i}" for j in range(50)) for i in range(20)]
    for entries in (1, 7):
        got = bpe.encode_documents(frame(spark, texts), public_tokenizers.path(VOCAB), public_tokenizers.PATTERN, entries=entries).collect()
        assert all(struct.unpack(f"<{len(r['ids_le32']) // 4}I", r["ids_le32"]) == tuple(reference.encode_ordinary(texts[r["doc_id"]])) for r in got)


def test_many_words_are_joined_once(codec):
    """The cache of a task holds the words of a large vocabulary."""
    own = BpeCodec(codec.ranks, public_tokenizers.PATTERN)
    letters = "bcdfghjklmnpqrstvwxz"
    text = " ".join("".join(letters[i // 20**k % 20] for k in range(4)) + "qx" for i in range(150_000))
    first, joins = own.encode(text).tobytes(), own.joins
    assert own.encode(text).tobytes() == first and own.joins == joins > 100_000
