"""Counts, moments, quantiles, correlations, regressions, rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import half_even, ratio, uniform, zscore


def whole():
    """A window over all rows: for small tables (groups or genes); with_totals() for others."""
    return Window.partitionBy(F.lit(1))


def with_totals(df: DataFrame, **totals) -> DataFrame:
    """The rows with aggregates of all of them: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(name) for name, c in totals.items()])))


def frequencies(df: DataFrame, by: str) -> DataFrame:
    """Count, share and percentage of each value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(whole())
    return counts.withColumn("freq", F.col("n") / total).withColumn("pct", F.col("n") * 100 / total)


def quota_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 123) -> DataFrame:
    """Proportional sample without replacement: round-half-even(share x n) rows of each stratum, as far as it has them."""
    quota = frequencies(df, stratum).select(stratum, F.least(half_even(F.col("freq") * n), F.col("n")).alias("quota"))
    order = Window.partitionBy(stratum).orderBy(uniform(seed, "sample", F.col(key)), key)
    # no quota is over n: each partition keeps its first n rows of a stratum, so a large stratum never meets in one task
    first = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return first.join(quota, stratum).where("_r <= quota").drop("_r", "quota")


def cap_sample(df: DataFrame, by: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each group."""
    order = Window.partitionBy(by).orderBy(uniform(seed, "cap", F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 123, stream: str = "rows") -> DataFrame:
    """n rows in a seeded order."""
    return df.orderBy(uniform(seed, stream, F.col(key)), key).limit(n)


def gene_stats(expr: DataFrame) -> DataFrame:
    """Mean, sample variance, cv, cv^2 and share of zeros of each gene; zeros must be rows."""
    s = expr.groupBy("gene_id").agg(F.avg("count").alias("mean_expr"), F.var_samp("count").alias("var_expr"), F.stddev_samp("count").alias("_sd"), F.avg((F.col("count") == 0).cast("double")).alias("zero_frac"), F.sum("count").alias("total"))
    return s.select("gene_id", "mean_expr", "var_expr", ratio(F.col("_sd"), F.col("mean_expr")).alias("cv_expr"), ratio(F.col("var_expr"), F.col("mean_expr") * F.col("mean_expr")).alias("cv2"), "zero_frac", "total")


def stable_genes(expr: DataFrame, q: float = 0.1) -> DataFrame:
    """Genes whose cv^2 lies below its q-quantile."""
    s = gene_stats(expr).select("gene_id", "cv2")
    cut = s.agg(F.percentile("cv2", F.lit(q)).alias("cut"))
    return s.crossJoin(F.broadcast(cut)).where("cv2 < cut").select("gene_id", "cv2")


def cell_stats(expr: DataFrame) -> DataFrame:
    """Total, detected features and share of zeros of each cell."""
    return expr.groupBy("cell_id").agg(F.sum("count").alias("n_count"), F.sum((F.col("count") > 0).cast("long")).alias("n_feature"), F.avg((F.col("count") == 0).cast("double")).alias("zero_frac"))


def expressed(expr: DataFrame) -> DataFrame:
    """Rows of genes with a positive total."""
    return expr.join(expr.groupBy("gene_id").agg(F.sum("count").alias("_t")).where("_t > 0").select("gene_id"), "gene_id", "left_semi")


def profile(expr: DataFrame) -> DataFrame:
    """Mean of each gene in each cluster."""
    return expr.groupBy("cluster", "gene_id").agg(F.avg("count").alias("mean_expr"))


def specificity(expr: DataFrame) -> DataFrame:
    """Largest cluster mean less the mean of the others, and the cluster that has it (the first of ties)."""
    s = profile(expr).groupBy("gene_id").agg(F.max("mean_expr").alias("_m"), F.sum("mean_expr").alias("_s"), F.count("*").alias("_k"), F.min_by("cluster", F.struct(-F.col("mean_expr"), F.col("cluster"))).alias("cluster"))
    return s.select("gene_id", "cluster", (F.col("_m") - F.coalesce(F.try_divide(F.col("_s") - F.col("_m"), F.col("_k") - 1), F.lit(0.0))).alias("specificity"))


def top_n(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def top_n_ties(df: DataFrame, by: str, score: str, n: int) -> DataFrame:
    """The n best of each group and those that tie with the last."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc(score)))).where(F.col("_r") <= n).drop("_r")


def representative_genes(expr: DataFrame) -> DataFrame:
    """The most specific gene of each cluster; gene 1 for a cluster that owns none."""
    best = specificity(expr).groupBy("cluster").agg(F.min_by("gene_id", F.struct(-F.col("specificity"), F.col("gene_id"))).alias("g"))
    return expr.select("cluster").distinct().join(best, "cluster", "left").select("cluster", F.coalesce("g", F.lit(1)).alias("gene_id"))


def cell_zscores(expr: DataFrame) -> DataFrame:
    """Each count against the counts of its cell."""
    return expr.withColumn("z", zscore(F.col("count"), Window.partitionBy("cell_id")))


def gene_correlation(expr: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of genes (g1 < g2): a self-join on the cell, summed before it is shuffled."""
    a, b = expr.select("cell_id", F.col("gene_id").alias("g1"), F.col("count").cast("double").alias("a")), expr.select("cell_id", F.col("gene_id").alias("g2"), F.col("count").cast("double").alias("b"))
    return a.join(b, "cell_id").where("g1 < g2").groupBy("g1", "g2").agg(F.corr("a", "b").alias("r"))


def running(counts: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """Adds the sum of n over all lesser values: sums within ranges of the values, and the sums of the ranges before, which are few."""
    ranged = counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()).persist()
    ends = ranged.groupBy("_part").agg(F.sum(n).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(out, within).join(F.broadcast(ends.select("_part", "_before")), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """Adds 1, 2, ... in the order of some columns: places within ranges, and the sizes of the ranges before, which are few."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    ends = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(out, place.cast("long")).join(F.broadcast(ends.select("_part", "_before")), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank with ties at their mean."""
    n = running(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_less")
    return df.join(n.select(value, (F.col("_less") + (F.col("_n") + 1) / 2).alias(out)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho of two columns, over the rows that have both; these are kept, since ranks read them again."""
    rows = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).persist()
    return average_rank(average_rank(rows, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins over the range; the largest value falls into the last."""
    r = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))) + 1, F.lit(bins))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(r)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, r^2, t of the slope and its two-sided p-value."""
    s = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    t = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))) * F.signum("slope")

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 2) if a == a and b > 2 else None for a, b in zip(t, n, strict=True)])

    return s.withColumn("t", t).withColumn("p_value", p_value("t", "n"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= c * d
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300))) / a
    return 1 - front * h if swap else front * h


def kernel_density(df: DataFrame, value: str, points: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at given points, from summed kernels (the points are few and given)."""
    at = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("at")
    z = (F.col(value) - F.col("at")) / bandwidth
    return df.where(F.col(value).isNotNull()).select(value, at).groupBy("at").agg((F.avg(F.exp(-z * z / 2)) / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def fit_negative_binomial(expr: DataFrame, positive_only: bool = True) -> DataFrame:
    """Maximum-likelihood size and mean of each gene from its histogram of counts; null for a gene without counts."""
    counts = (expr.where("count > 0") if positive_only else expr).groupBy("gene_id", "count").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c, n = pdf["count"].to_numpy(float), pdf["n"].to_numpy(float)
        mean = (c * n).sum() / n.sum()
        best, lo, hi = None, math.log(1e-3), math.log(1e5)
        gamma = np.vectorize(math.lgamma)
        like = lambda s: float((n * (gamma(c + math.exp(s)) - gamma(c + 1) - math.lgamma(math.exp(s)) + math.exp(s) * (s - math.log(math.exp(s) + mean)) + c * (math.log(max(mean, 1e-300)) - math.log(math.exp(s) + mean)))).sum())
        g = (math.sqrt(5) - 1) / 2
        for _ in range(80):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if like(a) > like(b) else (a, hi)
        best = math.exp((lo + hi) / 2)
        return pd.DataFrame({"gene_id": [pdf["gene_id"].iloc[0]], "size": [best], "mu": [mean]})

    fits = counts.groupBy("gene_id").applyInPandas(fit, "gene_id int, size double, mu double")
    return expr.select("gene_id").distinct().join(fits, "gene_id", "left")
