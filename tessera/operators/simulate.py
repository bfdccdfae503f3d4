"""The simulation: pixels to labelled cells to counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import normal, rescale, uniform
from tessera.operators import spatial, stats
from tessera.schema import Params


def threshold(pixels: DataFrame, value: float = 0.7) -> DataFrame:
    return pixels.where(F.col("value") < value)


def intensity_clusters(pixels: DataFrame, k: int, seed: int = 123, restarts: int = 5) -> DataFrame:
    """Adds intensity_cluster 1..k: the best of several k-means runs; numbers follow the rising centre."""
    v = VectorAssembler(inputCols=["value"], outputCol="_v", handleInvalid="skip").transform(pixels)
    best = min((KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_p").fit(v) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    order = {int(old): new + 1 for new, old in enumerate(np.argsort([c[0] for c in best.clusterCenters()]))}
    number = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("_p"))
    return best.transform(v).withColumn("intensity_cluster", number).drop("_v", "_p")


def marker_profile(spark: SparkSession, k: int, genes: int, markers: int, effect: float, overlap: float) -> DataFrame:
    """(cluster, gene_id, mu): 2, raised in the cluster's own block of genes, less so in the block before; blocks beyond the genes are empty."""
    grid = spark.range(1, k + 1).select(F.col("id").cast("int").alias("cluster")).withColumn("gene_id", F.explode(F.sequence(F.lit(1), F.lit(genes))))
    inside = lambda c: (F.col("gene_id") > (c - 1) * markers) & (F.col("gene_id") <= c * markers)
    c = F.col("cluster")
    mu = F.lit(2.0) + F.when(inside(c), effect).otherwise(0.0) + F.when((c > 1) & F.lit(overlap > 0) & inside(c - 1), overlap).otherwise(0.0)
    return grid.withColumn("mu", mu)


def hybrid_weights(pairs: DataFrame, cells: DataFrame, low: float = 0.2, high: float = 0.5, seed: int = 123) -> DataFrame:
    """(cell_id, other, weight): each pair weighs both ways; for a cell and a cluster the last pair (by src) counts."""
    c = cells.select("cell_id", "cluster")
    draw = lambda s: F.lit(low) + uniform(seed, s, F.col("src"), F.col("dst")) * (high - low)
    there = pairs.select(F.col("src").alias("cell_id"), F.col("dst").alias("o"), "src", F.lit(0).alias("way"), draw("there").alias("weight"))
    back = pairs.select(F.col("dst").alias("cell_id"), F.col("src").alias("o"), "src", F.lit(1).alias("way"), draw("back").alias("weight"))
    rows = there.union(back).join(c.select(F.col("cell_id").alias("o"), F.col("cluster").alias("other")), "o")
    return rows.groupBy("cell_id", "other").agg(F.max_by("weight", F.struct("src", "way", "o")).alias("weight"))


def hybrid_mix(base: DataFrame, weights: DataFrame, profile: DataFrame) -> DataFrame:
    """(cell_id, gene_id, mu): b <- b(1 - h) + mu h over the clusters in order; `base` has cell_id, gene_id, mu."""
    steps = weights.join(F.broadcast(profile.withColumnRenamed("cluster", "other").withColumnRenamed("mu", "m")), "other").groupBy("cell_id", "gene_id").agg(F.array_sort(F.collect_list(F.struct("other", "weight", "m"))).alias("s"))
    fold = F.aggregate("s", F.col("mu"), lambda b, t: b * (1 - t["weight"]) + t["m"] * t["weight"])
    return base.join(steps, ["cell_id", "gene_id"], "left").withColumn("mu", F.coalesce(fold, "mu")).drop("s")


def bernoulli_dropout(counts: DataFrame, p: Column, seed: int = 123) -> DataFrame:
    """Counts set to 0 with probability p, independently for each cell and gene."""
    return counts.withColumn("count", F.when(uniform(seed, "dropout", F.col("cell_id"), F.col("gene_id")) < p, F.lit(0)).otherwise(F.col("count")).cast("long"))


#: Means up to which counts are drawn by inverting their distribution, all rows at once; above, each row has a generator.
INVERTED = 200.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit keys."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _inverted(u: np.ndarray, first: np.ndarray, step) -> np.ndarray:
    """The least k whose cumulated probability exceeds u; first: the probability of 0, step(k, rows): that of k + 1 over that of k."""
    out, on, p = np.zeros(len(u), np.int64), np.arange(len(u)), first.copy()
    left, k = u.copy(), 0
    while len(on):
        left = left - p
        more = (left >= 0) & ((p > 1e-18) | (k < 10 * INVERTED))  # far in the tail rounding decides
        out[on[~more]] = k
        on, left, p = on[more], left[more], p[more]
        p = p * step(k, on)
        k += 1
    return out


def draw_counts(rows: DataFrame, seed: int, mode: str = "reference") -> DataFrame:
    """Adds count: binomial for stable genes, otherwise negative binomial (mu = log mean, size = dispersion).

    Each row's draw comes from a hash of cell and gene, so it doesn't depend on partitions. Stable genes: n = round(e^mu / 0.1) trials
    of 0.9 ("reference": the mean rises ninefold) or round(e^mu / 0.9) ("preserve").
    """
    share = 0.1 if mode == "reference" else 0.9
    names = rows.columns

    def run(batches):
        for pdf in batches:
            mean, size, stable = np.exp(np.clip(pdf["mu"].to_numpy(), -30, 20)), pdf["dispersion"].to_numpy(float), pdf["stable"].to_numpy(bool)
            keys = _mixed(_mixed(pdf["cell_id"].to_numpy().astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 2**64 - 1)) + pdf["gene_id"].to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            u = (keys >> np.uint64(11)).astype(float) / (1 << 53)
            out, trials = np.zeros(len(pdf), np.int64), np.rint(mean / share)
            low = np.flatnonzero(~stable & (mean <= INVERTED))
            ratio = mean[low] / (mean[low] + size[low])
            out[low] = _inverted(u[low], np.exp(size[low] * np.log1p(-ratio)), lambda k, on: (k + size[low][on]) / (k + 1) * ratio[on])
            low = np.flatnonzero(stable & (trials <= INVERTED))  # the failures
            out[low] = trials[low] - _inverted(u[low], 0.9 ** trials[low], lambda k, on: np.maximum(trials[low][on] - k, 0) / (k + 1) / 9)
            for i in np.flatnonzero(np.where(stable, trials, mean) > INVERTED).tolist():
                g = np.random.Generator(np.random.SFC64(int(keys[i])))
                out[i] = g.binomial(int(trials[i]), 0.9) if stable[i] else g.poisson(min(g.gamma(size[i], mean[i] / size[i]), 1e12))
            yield pdf.assign(count=out)[[*names, "count"]]

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("count", LongType())]))


def simulate(pixels: DataFrame, params: Params | None = None) -> dict[str, DataFrame]:
    """cells (cell_id, x, y, value, cluster, name), expression (cell_id, gene_id, count) and params of one simulation."""
    p = (params or Params()).resolved()
    spark = pixels.sparkSession
    kept = intensity_clusters(threshold(pixels, p.threshold), p.k, p.seed).withColumnRenamed("intensity_cluster", "cluster")
    kept = kept.withColumn("_key", F.xxhash64("x", "y"))
    picked = stats.quota_sample(kept, "cluster", "_key", p.n_cells, p.seed)
    cells = stats.numbered(picked.select("x", "y", "value", "cluster"), "cell_id", "cluster", "y", "x").select("cell_id", "x", "y", "value", "cluster").withColumn("name", F.concat(F.lit("cells_"), F.chr(F.lit(96) + F.col("cluster"))))
    cells = cells.persist()  # read by every step below; recomputed if an executor is lost
    profile = marker_profile(spark, p.k, p.n_genes, p.markers, p.marker_effect, p.overlap_effect)
    maps = spatial.spatial_maps(cells, p.dispersion, p.dropout).drop("mean_dist")
    base = cells.join(F.broadcast(profile), "cluster").select("cell_id", "gene_id", "mu")
    if p.hybrids:
        pairs = spatial.hybrid_pairs(cells, most=p.max_pairs, seed=p.seed + 1).persist()  # at most max_pairs rows, read twice
        base = hybrid_mix(base, hybrid_weights(pairs, cells, *p.hybrid_weight, p.seed), profile)
    mu = F.col("mu") + normal(p.seed, "cell", F.col("cell_id"), F.col("gene_id")) * p.cell_sd
    rows = base.join(maps, "cell_id")
    if p.spatial:
        rows = rows.join(spatial.gaussian_field(cells, p.noise_range, p.seed), "cell_id")
        mu = mu + F.col("field") * p.noise_intensity + normal(p.seed, "noise", F.col("cell_id"), F.col("gene_id")) * p.random_sd
    genes = stats.uniform_sample(spark.range(1, p.n_genes + 1).select(F.col("id").cast("int").alias("gene_id")), "gene_id", max(1, round(0.1 * p.n_genes)), p.seed, "stable").withColumn("stable", F.lit(True))
    rows = rows.join(F.broadcast(genes), "gene_id", "left").select("cell_id", "gene_id", mu.alias("mu"), "dispersion", "dropout", F.coalesce("stable", F.lit(False)).alias("stable"))
    counts = bernoulli_dropout(draw_counts(rows, p.seed, p.stable_mean_mode), F.col("dropout"), p.seed).select("cell_id", "gene_id", "count")
    return {"cells": cells, "expression": counts, "params": spark.createDataFrame(pd.DataFrame([p.row()]))}
