"""Contingency, label matching and scores of clusterings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rank_label, ratio


def levels(pairs: DataFrame) -> DataFrame:
    """All labels in order: sorted true ones, then predicted-only ones."""
    t, p = pairs.select(F.col("true").alias("label"), F.lit(0).alias("s")), pairs.select(F.col("pred").alias("label"), F.lit(1).alias("s"))
    every = t.union(p).where(F.col("label").isNotNull()).groupBy("label").agg(F.min("s").alias("s"))
    return every.select("label", F.row_number().over(Window.orderBy("s", "label")).alias("level"))


def contingency(pairs: DataFrame) -> DataFrame:
    """(true, pred, n) for all combinations of labels, zeros among them; rows without one of the labels are left out."""
    pairs = pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull())
    n = pairs.groupBy("true", "pred").agg(F.count("*").alias("n"))
    grid = pairs.select("true").distinct().crossJoin(F.broadcast(pairs.select("pred").distinct()))
    return grid.join(n, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def margins(pairs: DataFrame) -> DataFrame:
    """Counts by cell, row, column and in all."""
    return pairs.cube("true", "pred").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("grouping"))


def size_rank_labels(df: DataFrame, label: str, k: int, *, out: str = "renamed", noise: str | None = None) -> DataFrame:
    """Clusters by falling size as cells_a, cells_b, ...; those beyond k are noise. `noise`: a label that is always noise."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    ranked = sizes if noise is None else sizes.where(F.col(label).cast("string") != noise)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), label)))
    names = ranked.select(label, rank_label(F.col("rank"), k).alias(out))
    return df.join(F.broadcast(names), label, "left").withColumn(out, F.coalesce(out, F.lit("noise")))


def class_metrics(pairs: DataFrame, method: str) -> DataFrame:
    """Method, Class, True_Positives, False_Positives, False_Negatives, Precision for each label and in total."""
    seen = pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull())
    hit = seen.groupBy(F.col("true").alias("label")).agg(F.sum((F.col("true") == F.col("pred")).cast("long")).alias("tp"), F.count("*").alias("nt"))
    got = seen.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("np"))
    rows = levels(pairs).join(hit, "label", "left").join(got, "label", "left").na.fill(0, ["tp", "nt", "np"])
    rows = rows.select(F.col("label").alias("Class"), F.col("level").alias("o"), F.col("tp").alias("True_Positives"), (F.col("np") - F.col("tp")).alias("False_Positives"), (F.col("nt") - F.col("tp")).alias("False_Negatives"))
    total = rows.agg(F.lit("Total").alias("Class"), F.lit(2**31 - 1).alias("o"), *[F.sum(c).alias(c) for c in ("True_Positives", "False_Positives", "False_Negatives")])
    precision = ratio(F.col("True_Positives"), F.col("True_Positives") + F.col("False_Positives")).alias("Precision")
    return rows.unionByName(total).select(F.lit(method).alias("Method"), "Class", "True_Positives", "False_Positives", "False_Negatives", precision)


def adjusted_rand_index(pairs: DataFrame) -> DataFrame:
    """One row: ari; 1 where both sides are a single cluster."""
    n = pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull()).groupBy("true", "pred").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    cells = n.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    rows = n.groupBy("true").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    cols = n.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), two(F.col("all")))
    return cells.crossJoin(rows).crossJoin(cols).select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def _table(pairs: DataFrame) -> tuple[list, list, np.ndarray]:
    """The contingency table on the driver: as many cells as pairs of labels, few; rows without one of the labels are left out."""
    rows = pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull()).groupBy("true", "pred").agg(F.count("*").alias("n")).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("too many pairs of labels")
    t, p = sorted({r["true"] for r in rows}), sorted({r["pred"] for r in rows})
    out = np.zeros((len(t), len(p)), np.int64)
    for r in rows:
        out[t.index(r["true"]), p.index(r["pred"])] = r["n"]
    return t, p, out


def log_factorial(n) -> np.ndarray:
    """Natural logarithms of factorials of whole numbers: by a table up to 255, by Stirling's series beyond."""
    n = np.asarray(n, float)
    x = np.maximum(n, 1) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    return np.where(n < 256, table[np.minimum(n, 255).astype(int)], series)


def mutual_information(table: np.ndarray, average: str = "max") -> float:
    """Adjusted mutual information of a contingency table, by the exact expectation."""
    n, a, b = table.sum(), table.sum(1), table.sum(0)
    h = lambda v: -sum(x / n * math.log(x / n) for x in v if x)
    mi = sum(x / n * math.log(n * x / (a[i] * b[j])) for (i, j), x in np.ndenumerate(table) if x)
    fact = log_factorial
    emi = 0.0
    for x in a.tolist():
        for y in b.tolist():
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            w = np.exp(fact(x) + fact(y) + fact(n - x) + fact(n - y) - fact(n) - fact(k) - fact(x - k) - fact(y - k) - fact(n - x - y + k))
            emi += float((k / n * np.log(n * k / (x * y)) * w).sum())
    top = {"max": max, "min": min, "mean": lambda u, v: (u + v) / 2}[average](h(a), h(b))
    return 1.0 if abs(top - emi) < 1e-15 else (mi - emi) / (top - emi)


def adjusted_mutual_information(pairs: DataFrame, average: str = "max") -> DataFrame:
    return pairs.sparkSession.createDataFrame([(float(mutual_information(_table(pairs)[2], average)),)], "ami double")


def assignment(cost: np.ndarray) -> list[int]:
    """For each row of a square cost matrix its column, at least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j], i0, delta, j1 = True, match[j], math.inf, 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = cost[i0 - 1][k - 1] - u[i0] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, j1 = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = j1
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def optimal_map(table: np.ndarray) -> list[int | None]:
    """For each column (predicted) the row (true) it matches, at most overlap; None beyond the rows."""
    n = max(table.shape)
    square = np.zeros((n, n))
    square[: table.shape[1], : table.shape[0]] = table.T
    return [j if j < table.shape[0] else None for j in assignment(square.max() - square)[: table.shape[1]]]


def optimal_assignment(pairs: DataFrame, unmatched: str = "null") -> DataFrame:
    """(pred, true, n): the best one-to-one match of predicted to true labels; surplus ones match null, or raise ("error")."""
    t, p, table = _table(pairs)
    found = optimal_map(table)
    if unmatched == "error" and None in found:
        raise ValueError("more predicted than true labels")
    rows = [(p[j], None if i is None else t[i], 0 if i is None else int(table[i, j])) for j, i in enumerate(found)]
    kind = {f.name: f.dataType for f in pairs.schema}
    from pyspark.sql.types import LongType, StructField, StructType

    return pairs.sparkSession.createDataFrame(rows, StructType([StructField("pred", kind["pred"]), StructField("true", kind["true"]), StructField("n", LongType())]))


def relabelled(pairs: DataFrame, unmatched: str = "null") -> DataFrame:
    """The pairs with each predicted label replaced by its match."""
    m = optimal_assignment(pairs, unmatched).select("pred", F.col("true").alias("_m"))
    return pairs.join(F.broadcast(m), "pred", "left").drop("pred").withColumnRenamed("_m", "pred")


def pairs_of(spark: SparkSession, table: list[list[int]], true: list[str], pred: list[str]) -> DataFrame:
    """Label pairs that a contingency table counts."""
    rows = [(t, p, n) for t, row in zip(true, table, strict=True) for p, n in zip(pred, row, strict=True) if n]
    return spark.createDataFrame(rows, "true string, pred string, n int").select("true", "pred", F.explode(F.sequence(F.lit(1), "n")).alias("_i")).drop("_i")
