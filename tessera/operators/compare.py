"""Markers, and simulated data against a reference."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import standard
from tessera.operators import evaluate, preprocess, spatial, stats


def marker_rank_sum(rows: DataFrame, value: str = "count") -> DataFrame:
    """(cluster, gene_id, u, z): rank-sum statistic of each cluster against the other cells, with the tie correction.

    Equal values are counted first, so ranks come from a running sum over the distinct values of a gene.
    """
    v = rows.groupBy("gene_id", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("gene_id").orderBy(value)
    ranks = v.withColumn("rank", F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2)
    ties = v.groupBy("gene_id").agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"), F.sum("n").cast("double").alias("all"))
    per = rows.groupBy("cluster", "gene_id", value).agg(F.count("*").alias("m"))
    s = per.join(ranks, ["gene_id", value]).groupBy("cluster", "gene_id").agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").cast("double").alias("a"))
    s = s.join(ties, "gene_id").withColumn("u", F.col("r") - F.col("a") * (F.col("a") + 1) / 2)
    b = F.col("all") - F.col("a")
    var = F.col("a") * b / 12 * (F.col("all") + 1 - F.try_divide(F.col("ties"), F.col("all") * (F.col("all") - 1)))
    return s.select("cluster", "gene_id", "u", F.try_divide(F.col("u") - F.col("a") * b / 2, F.sqrt(var)).alias("z"))


def markers(expr: DataFrame, min_pct: float = 0.25, log_fc: float = 0.25) -> DataFrame:
    """Genes raised in a cluster: share of cells, log2 fold change of mean normalised counts, rank-sum z."""
    rows = preprocess.log_normalize(expr)
    whole = rows.groupBy("gene_id").agg(F.sum((F.col("count") > 0).cast("double")).alias("_p"), F.sum(F.expm1("value")).alias("_s"), F.count("*").alias("_n"))
    own = rows.groupBy("cluster", "gene_id").agg(F.sum((F.col("count") > 0).cast("double")).alias("p"), F.sum(F.expm1("value")).alias("s"), F.count("*").alias("n"))
    j = own.join(whole, "gene_id")
    rest = F.col("_n") - F.col("n")
    fc = F.log2(F.col("s") / F.col("n") + 1) - F.log2(F.coalesce(F.try_divide(F.col("_s") - F.col("s"), rest), F.lit(0.0)) + 1)
    j = j.select("cluster", "gene_id", (F.col("p") / F.col("n")).alias("pct"), F.coalesce(F.try_divide(F.col("_p") - F.col("p"), rest), F.lit(0.0)).alias("pct_rest"), fc.alias("avg_log2fc"))
    return j.where(f"greatest(pct, pct_rest) >= {min_pct} and avg_log2fc >= {log_fc}").join(marker_rank_sum(rows, "value"), ["cluster", "gene_id"])


def marker_summary(found: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Markers of each cluster, and the best n of each with ties."""
    return found.groupBy("cluster").agg(F.count("*").alias("n")), stats.top_n_ties(found, "cluster", "avg_log2fc", n)


def compare_expression(sim: DataFrame, ref: DataFrame, n_genes: int = 40, seed: int = 42) -> DataFrame:
    """Gene statistics of both, stacked: of common genes, or of each side's own (suffixed) where fewer than n are common."""
    a, b = sim.select("gene_id").distinct(), ref.select("gene_id").distinct()
    common = a.intersect(b)
    enough = common.limit(n_genes).count() >= n_genes
    side = lambda df, own, name: stats.gene_stats(df.join(F.broadcast(stats.uniform_sample(common if enough else own, "gene_id", n_genes, seed, "genes")), "gene_id", "left_semi")).select(F.concat(F.lit("gene-"), F.col("gene_id"), F.lit("" if enough else f"_{name}")).alias("gene"), "mean_expr", "var_expr", "cv_expr", "zero_frac", F.lit(name).alias("dataset"))
    return side(sim, a, "SIM").unionByName(side(ref, b, "REF"))


def gene_correlations(sim: DataFrame, ref: DataFrame, top: int = 50, value: str = "count", least: int = 5) -> DataFrame:
    """(Gene1, Gene2, Corr, Dataset) of both, both ways and with the diagonal, as tables of correlation matrices.

    Of the genes that are among the `top` most variable of either side, if there are at least `least`; else of each side's own top genes. value: the
    column that is correlated ("count", or a normalised layer).
    """
    tops = [[r.gene_id for r in preprocess.variable_genes(df, top).select("gene_id").collect()] for df in (sim, ref)]  # at most `top` a side
    common = sorted(set(tops[0]) & set(tops[1]))
    if len(common) >= least:
        tops = [common, common]
    out = None
    for df, genes, name in ((sim, tops[0], "SIM"), (ref, tops[1], "REF")):
        rows = df.where(F.col("gene_id").isin(genes)).select("cell_id", "gene_id", F.col(value).alias("count"))
        both = F.explode(F.array(F.struct(F.col("g1").alias("Gene1"), F.col("g2").alias("Gene2")), F.struct(F.col("g2").alias("Gene1"), F.col("g1").alias("Gene2")))).alias("p")
        part = stats.gene_correlation(rows).select(both, F.col("r").alias("Corr")).select("p.*", "Corr")
        part = part.union(rows.select("gene_id", F.col("gene_id").alias("g"), F.lit(1.0).alias("r")).distinct()).withColumn("Dataset", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def matrix_similarity(correlations: DataFrame) -> DataFrame:
    """rho: Spearman correlation of the upper triangles of both matrices; genes are matched by place in their order, as far as both sides have them."""
    genes = {name: sorted(r.g for r in correlations.where(F.col("Dataset") == name).select(F.col("Gene1").alias("g")).distinct().collect()) for name in ("SIM", "REF")}  # two matrices' rows
    place = lambda c: F.when(F.col("Dataset") == "SIM", F.array_position(F.lit(genes["SIM"] or [0]), F.col(c))).otherwise(F.array_position(F.lit(genes["REF"] or [0]), F.col(c)))
    rows = correlations.select("Dataset", "Corr", place("Gene1").alias("i"), place("Gene2").alias("j")).where("i < j")
    side = lambda name: F.max(F.when(F.col("Dataset") == name, F.col("Corr")))
    return stats.spearman(rows.groupBy("i", "j").agg(side("SIM").alias("r"), side("REF").alias("q")), "r", "q")


def correlation_of_correlations(sim: DataFrame, ref: DataFrame, top: int = 50) -> DataFrame:
    """Spearman correlation of the gene correlations that both have, among the most expressed common genes."""
    common = sim.groupBy("gene_id").agg(F.sum("count").alias("t")).join(ref.select("gene_id").distinct(), "gene_id", "left_semi")
    genes = stats.top_n(common, "t", "gene_id", top).select("gene_id")
    pick = lambda df: stats.gene_correlation(df.join(F.broadcast(genes), "gene_id", "left_semi"))
    return stats.spearman(pick(sim).join(pick(ref).withColumnRenamed("r", "q"), ["g1", "g2"]), "r", "q")


def compare_spatial(sim: DataFrame, ref: DataFrame, k: int = 5, rows: int | None = None, seed: int = 123) -> DataFrame:
    """Mean distance to k neighbours and cv of distances, on z-scored coordinates of finite rows: of all, or of a sample of at most `rows` of each."""
    out = None
    for name, df in (("simulated", sim), ("reference", ref)):
        ok = df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x", "y")))
        ok = stats.with_totals(ok.select("cell_id", "x", "y"), **{f"_{f}{c}": getattr(F, g)(c) for c in ("x", "y") for f, g in (("m", "avg"), ("s", "stddev_samp"))})
        z = ok.select("cell_id", *[standard(F.col(c), F.col(f"_m{c}"), F.col(f"_s{c}")).alias(c) for c in ("x", "y")]).where("x is not null and y is not null")
        part = z if rows is None else stats.uniform_sample(z, "cell_id", rows, seed)
        row = spatial.knn_mean_distance(part, k).agg(F.avg("mean_dist").alias("nn_dist")).crossJoin(spatial.distance_summary(part)).select(F.lit(name).alias("dataset"), "nn_dist", "mean_dist", "sd_dist", "cv")
        out = row if out is None else out.unionByName(row)
    return out


def dropout_test(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of zeros against the distance to the nearest centroid."""
    return stats.regression(stats.cell_stats(expr).join(spatial.nearest_centroid(cells), "cell_id"), "zero_frac", "dist_to_center")


def structure(expr: DataFrame, dims: int = 20, resolution: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(cell_id, community) of a dataset, and the mean silhouette of its communities on the components."""
    scores, _ = preprocess.pca(preprocess.scale_genes(preprocess.log_normalize(expr)), "scaled", dims)
    scores = scores.persist()
    found = preprocess.communities(scores, resolution).persist()
    flat = scores.select("cell_id", *[F.col("v")[i].alias(f"c{i}") for i in range(dims)]).join(found.withColumnRenamed("community", "cluster"), "cell_id")
    return found, spatial.silhouette(flat, "cell_id", tuple(f"c{i}" for i in range(dims))).agg(F.avg("silhouette").alias("mean_silhouette"))


def compare_clustering(sim: dict[str, DataFrame], ref: dict[str, DataFrame], dims: int = 20, resolution: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(test, value) of the clusterings of both datasets, and (dataset, cluster, prop_size): the share of cells of each cluster.

    The tests: mean silhouette of both, ARI of the simulated clusters against the found ones, number of clusters of both.
    """
    (a, sil_a), (b, sil_b) = (structure(x["expression"], dims, resolution) for x in (sim, ref))
    pairs = sim["cells"].select("cell_id", F.col("cluster").cast("string").alias("true")).join(a.select("cell_id", F.col("community").cast("string").alias("pred")), "cell_id")
    named = lambda df, test, value: df.select(F.lit(test).alias("test"), F.col(value).cast("double").alias("value"))
    count = lambda df: df.agg(F.count_distinct("community").alias("n"))
    rows = [named(sil_a, "Silhouette (sim)", "mean_silhouette"), named(sil_b, "Silhouette (ref)", "mean_silhouette"), named(evaluate.adjusted_rand_index(pairs), "ARI (sim vs original)", "ari"), named(count(a), "N clusters (sim)", "n"), named(count(b), "N clusters (ref)", "n")]
    sizes = [stats.frequencies(df, "community").select(F.lit(name).alias("dataset"), F.col("community").alias("cluster"), F.col("freq").alias("prop_size")) for df, name in ((a, "SIM"), (b, "REF"))]
    return functools.reduce(DataFrame.union, rows), sizes[0].union(sizes[1])


def compare_markers(sim: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, cluster, n_markers), and (dataset, avg_log2fc) of all markers of both."""
    found = [markers(df).select(F.lit(name).alias("dataset"), "cluster", "avg_log2fc") for df, name in ((sim, "SIM"), (ref, "REF"))]
    both = found[0].union(found[1])
    return both.groupBy("dataset", "cluster").agg(F.count("*").alias("n_markers")), both.select("dataset", "avg_log2fc")


def validation_summary(sim: dict[str, DataFrame], ref: dict[str, DataFrame], dims: int = 20, resolution: float = 0.5) -> DataFrame:
    """(test, value): six figures of a simulated against a reference dataset."""
    tests, _ = compare_clustering(sim, ref, dims, resolution)
    drop = dropout_test(sim["expression"], sim["cells"])
    return tests.union(drop.select(F.lit("Dropout-distance p-value"), "p_value"))


def reduced_validation(sim: DataFrame, ref: DataFrame, n_genes: int = 40, top: int = 50, cap: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without clusterings: gene statistics of both, correlation matrices of both (the first `cap` rows of each, for plots), and their similarity."""
    layer = lambda df: preprocess.log_normalize(df.select("cell_id", "gene_id", "count"))
    matrices = gene_correlations(layer(sim), layer(ref), top, "value").persist()  # at most 2 x top x top rows
    shown = matrices.withColumn("_r", F.row_number().over(Window.partitionBy("Dataset").orderBy("Gene2", "Gene1"))).where(F.col("_r") <= cap).drop("_r")
    return compare_expression(sim, ref, n_genes), shown, matrix_similarity(matrices)


def diagnostics(cells: DataFrame, expr: DataFrame, *, dispersion=(5.0, 0.5), dropout=(0.1, 0.5), bins: int = 50, top: int = 20, per_cluster: int = 500, grid: int = 100) -> dict[str, DataFrame]:
    """Ten tables ready to plot."""
    e = expr if "cluster" in expr.columns else expr.join(cells.select("cell_id", "cluster"), "cell_id")
    maps = spatial.spatial_maps(cells, dispersion, dropout)
    at = cells.select("cell_id", "x", "y", "cluster")
    best = stats.top_n(stats.specificity(e), "specificity", "gene_id", top).select("gene_id")
    heat = stats.cell_zscores(stats.cap_sample(e.select("cell_id", "cluster").distinct(), "cluster", "cell_id", per_cluster).select("cell_id").join(e, "cell_id").join(F.broadcast(best), "gene_id", "left_semi"))
    rep = stats.representative_genes(e)
    return {
        "spatial": at,
        "profile": stats.profile(e),
        "distance": maps.select("cell_id", "mean_dist").join(at, "cell_id"),
        "dispersion": maps.select("cell_id", "mean_dist", "dispersion"),
        "dropout": maps.select("cell_id", "mean_dist", "dropout"),
        "histogram": stats.histogram(e.join(stats.stable_genes(e), "gene_id", "left_anti"), "count", bins),
        "observed_dropout": stats.cell_stats(e).join(at, "cell_id"),
        "heatmap": heat,
        "representative": e.join(F.broadcast(rep.select("gene_id").distinct()), "gene_id", "left_semi").join(at.select("cell_id", "x", "y"), "cell_id"),
        "density": spatial.radius_count(cells, 10.0).join(at, "cell_id"),
    }

