"""The public entry points: simulate, cluster and compare, diagnose, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import compare, evaluate, preprocess, simulate
from tessera.schema import Params


def simulate_spatial_counts(spark: SparkSession, image_path: str | None = None, output_path: str | None = None, *, pixels: DataFrame | None = None, **params) -> dict[str, DataFrame]:
    """A labelled population of cells with counts from an image (or a pixel table); written as a bundle where a path is given."""
    table = pixels if pixels is not None else sources.read_image(spark, image_path)
    out = simulate.simulate(table, Params(**params))
    if output_path:
        sources.write_bundle(out, output_path)
    return out


def clustered(bundle: dict[str, DataFrame], k: int | None = None, resolution: float = 0.25, min_points: int = 7, dims: int = 30) -> tuple[DataFrame, DataFrame]:
    """(cell_id, true, graph, density) and (cell_id, v): labels of both clusterings, and the layout."""
    cells, expr = sources.require(bundle["cells"], "cell_id", "cluster"), preprocess_genes(bundle["expression"])
    scores, _ = preprocess.pca(preprocess.pearson_residuals(expr), "residual", dims)
    scores = scores.persist()
    graph = preprocess.communities(scores, resolution).withColumnRenamed("community", "graph")
    if graph.select("graph").distinct().count() < 2:
        import warnings

        warnings.warn("fewer than two communities", stacklevel=2)
    flat = preprocess.layout(scores)
    dense = preprocess.density_clusters(flat, min_points).withColumnRenamed("community", "density")
    return cells.select("cell_id", F.col("cluster").cast("string").alias("true")).join(graph, "cell_id").join(dense, "cell_id"), flat


def preprocess_genes(expr: DataFrame) -> DataFrame:
    from tessera.operators.stats import expressed

    return expressed(expr)


def compare_clusters(labels: DataFrame, k: int, policy: str = "size_rank", noise_aware: bool = False) -> DataFrame:
    """Metrics of both clusterings under a policy of matching labels: "size_rank", "optimal" or "label_free" (ARI and AMI)."""
    out = None
    for method in ("graph", "density"):
        pairs = labels.select("true", F.col(method).cast("string").alias("pred"))
        if policy == "label_free":
            part = evaluate.adjusted_rand_index(pairs).crossJoin(evaluate.adjusted_mutual_information(pairs)).select(F.lit(method).alias("Method"), F.col("ari").alias("ARI"), F.col("ami").alias("AMI"))
        elif policy == "optimal":
            part = evaluate.class_metrics(evaluate.relabelled(pairs), f"{method}_optimal")
        elif policy == "size_rank":
            t = evaluate.size_rank_labels(pairs, "true", k, out="t")
            p = evaluate.size_rank_labels(t, "pred", k, out="p", noise="0" if noise_aware and method == "density" else None)
            part = evaluate.class_metrics(p.select(F.col("t").alias("true"), F.col("p").alias("pred")), method)
        else:
            raise ValueError("policy must be size_rank, optimal or label_free")
        out = part if out is None else out.unionByName(part)
    return out


def analyze_and_compare(spark: SparkSession, path: str, output: str | None = None, *, k: int | None = None, resolution: float = 0.25, min_points: int = 7, policy: str = "size_rank") -> DataFrame:
    """Reads a bundle, clusters it twice, scores both; writes metrics as CSV and labels as Parquet beside it where `output` is given."""
    bundle = sources.read_bundle(spark, path, "cells", "expression")
    labels, _ = clustered(bundle, k, resolution, min_points)
    metrics = compare_clusters(labels, sources.resolve_k(bundle["cells"], k), policy)
    if output:
        sources.write_csv(metrics.coalesce(1), output)
        labels.write.mode("overwrite").parquet(sources.output_name(output, "_labels"))
    return metrics


def diagnose(spark: SparkSession, path: str, output: str | None = None) -> dict[str, DataFrame]:
    bundle = sources.read_bundle(spark, path, "cells", "expression")
    tables = compare.diagnostics(bundle["cells"], bundle["expression"])
    if output:
        sources.write_bundle(tables, output)
    return tables


def validate(spark: SparkSession, simulated: str, reference: str, output: str | None = None) -> DataFrame:
    """(test, value) of a simulated against a reference dataset; written as CSV where `output` is given."""
    a, b = (sources.read_bundle(spark, p, "cells", "expression") for p in (simulated, reference))
    summary = compare.validation_summary(a, b)
    if output:
        sources.write_csv(summary.coalesce(1), output)
    return summary


def validate_reduced(spark: SparkSession, simulated: str, reference: str, output: str | None = None) -> dict[str, DataFrame]:
    """Gene statistics, correlation matrices and their similarity, without clusterings; CSV and a line of text in the folder `output` where it is given."""
    a, b = (sources.read_bundle(spark, p, "cells", "expression")["expression"] for p in (simulated, reference))
    expression, matrices, rho = compare.reduced_validation(a, b)
    if output:
        sources.make_folder(output)
        sources.write_csv(expression.coalesce(1), f"{output}/expression_stats.csv")
        sources.write_text([f"Correlation of correlation matrices (spearman): {rho.first()['rho']}"], f"{output}/correlation_of_correlations.txt")
    return {"expression": expression, "correlations": matrices, "similarity": rho}
