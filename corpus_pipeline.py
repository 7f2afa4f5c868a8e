"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Counted as part of the subpackage weftgraph.llm. Every stage takes (spark, docs,
sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents.

Defined cases: a null text scores as an empty one, has no line, links with nothing,
holds no passage and encodes to no ids; texts of any length are taken whole; rows with
a null doc_id stay as long as their text does; rows that repeat a doc_id are one
document for line dedup, and one of them is left after the Jaccard stage; ties go to
the smallest doc_id. Columns that documents has besides are kept, whatever they are
called. Empty tables give empty results with the same columns; without labels nothing
is rejected, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, decontam, linededup, paritysketch, ranker
from weftgraph.llm.common import cut, held_out

VOCAB = "byte_bpe_multi_50k.tiktoken"
#: Entries of the encoder's caches here, where the workers and the JVM still hold memory of earlier stages.
CACHED = 20_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ranker.keep(docs, ranker.learn(docs, labels, lambda c: ~held_out(c, 4, 2)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one within two edits."""
    return linededup.remove_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by shingles of five words and a similarity of 0.8."""
    return paritysketch.keep_one(docs, paritysketch.Join(words=5, num=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of any benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of what is left, as counts and digests."""
    return bpe.token_digests(bpe.encode_documents(docs, public_tokenizers.path(VOCAB), public_tokenizers.PATTERN, entries=CACHED))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]
#: SQL expresses neither the ranking nor the encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a checkpoint between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
