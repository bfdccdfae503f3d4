"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


#: Bytes of text of each label that a sample holds at most; a text of more than a sixteenth of these is not fitted.
BYTES = 1 << 26


def sample(documents: DataFrame, labels: DataFrame, target: str, *, folds: int, held_out: int, most: dict[int, int], size: int = BYTES) -> DataFrame:
    """(doc_id, text, label) of at most most[label] labelled documents of each label outside the held-out fold, and of at most `size` bytes.

    The choice goes by a hash of the id, not by place. Ids without label, null ids and null labels never enter;
    conflicting labels of one id count as the smaller, and rows that repeat an id all count. The chosen ids are at most sum(most.values()): they and the
    bytes of their texts come to the driver, and are broadcast. Documents are read twice and not shuffled.
    """
    rows = labels.select("doc_id", F.col(target).alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isNotNull() & (fold("doc_id", folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    chosen = None
    for label, n in most.items():
        part = rows.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = documents.select("doc_id", length.alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.sum("n").alias("n"), F.max("n").alias("longest"))
    sums: dict[int, int] = {}
    kept = []
    for r in sorted(found.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["longest"] <= size // 16 and sums.get(r["_label"], 0) + r["n"] <= size:
            sums[r["_label"]] = sums.get(r["_label"], 0) + r["n"]
            kept.append((r["doc_id"], int(r["_label"])))
    ids = documents.sparkSession.createDataFrame(kept, T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("_label", T.IntegerType())]))
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("_label").alias("label"))
