import hashlib
import struct

import brute
import public_tokenizers
import tiktoken

import corpus_pipeline
from weftgraph.llm import ranker
from weftgraph.llm.bpe import read_ranks
from weftgraph.llm.common import held_out


def test_against_plain_stages(spark, tmp_path):
    """A small corpus through run() and through plain versions of the stages."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) < 1200")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judge = ranker.learn(docs, spark.read.parquet(f"{source}/labels.parquet"), lambda c: ~held_out(c, 4, 2))
    rejected = {r["doc_id"] for r in ranker.score(docs, judge).collect() if r["score"] < ranker.CUT}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected)
    gone = brute.dropped_lines(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, []))) for i, t in rows]
    rows = [r for r, (i, _, c) in zip(rows, brute.components(rows, 5, 80), strict=True) if i == c]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    bad = {i for i, _, _, f in brute.hits(rows, bench) if len(f) >= 1}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.VOCAB)), special_tokens={})
    want = []
    for i, t in rows:
        if i not in bad:
            ids = enc.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


def test_one_benchmark_item_is_enough(spark, tmp_path):
    """A document with a passage of a single benchmark item leaves the decontaminate stage."""
    items = [(1, "one two three four five six seven eight nine"), (2, "uno dos tres cuatro cinco seis siete ocho nueve")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(0, "nothing of the kind"), (1, "so: ONE two three four five six seven eight nine ten"), (2, " ".join(t for _, t in items)), (3, "one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows, empty and long texts, and columns with names that the stages use themselves."""
    from pyspark.sql import functions as F

    source = "/root/testdata/sf0.001"
    rows = [(1, None), (2, ""), (None, "a text whose row has no number at all"), (3, "the same row twice"), (3, "the same row twice"), (4, "word " * 30_000), (5, "x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__id_hash", "__gone", "__own_id", "__words", "__slot", "__maybe", "node", "h", "lang", "source", "id"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{source}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        left = left.checkpoint()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == 7 and {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
