"""From raw documents to encoded training data: five stages, each over all that the one before kept.

Null and empty texts get a quality score like any other and go or stay by it; later stages keep them (they have no lines with words, no shingles, no
benchmark words, and no ids). Of rows that repeat an id or a text each is judged; the n-gram join keeps one of each group of near copies. Without labels
every score is 0.5, so that nothing is kept. Other columns of the documents pass the first four stages, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from tessera.llm.store import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; the field is fitted to labelled rows of `docs` outside the held-out fold."""
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = quality.score(renamed, field, text=f"c{names.index('text')}", output="score").where(F.col("score") >= 0.7)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line."""
    return line_dedup.without_repeats(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.first_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate (fewer than a twentieth of the words are hit)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of ids and of the bytes they decode to."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]
#: The classifier is fitted by descent, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
