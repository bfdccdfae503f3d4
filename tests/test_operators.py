"""Golden metrics, oracle parity, brute force and properties of the operators."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tessera import plans, queries, sources
from tessera.functions import half_even, rank_label, uniform
from tessera.operators import compare, evaluate, preprocess, simulate, spatial, stats
from tessera.schema import Params

TRUE = list("abcde")
GOLDEN = {
    "easy graph": ([[8114, 32, 23, 15, 2], [35, 7332, 47, 12, 2], [18, 8, 7052, 14, 4], [13, 9, 12, 4992, 6], [7, 0, 2, 3, 2246]], list("abcde"), 29736, 0.976895, 29736),
    "medium graph": ([[1003, 6511, 242, 190, 240], [1098, 191, 5781, 180, 178], [922, 191, 201, 5386, 396], [4446, 129, 136, 203, 118], [233, 85, 31, 40, 1869]], list("abcde"), 3467, 0.567658, 23993),
    "easy density": ([[8112, 28, 26, 12, 8], [43, 7332, 35, 13, 5], [17, 11, 7046, 11, 11], [16, 10, 15, 4978, 13], [3, 1, 2, 0, 2252]], list("abcde"), 29720, 0.975998, 29720),
    "medium density": ([[4447, 175, 574, 11, 383, 2596], [4278, 132, 18, 23, 11, 2966], [3896, 273, 15, 10, 10, 2892], [2933, 106, 7, 385, 7, 1594], [377, 1720, 8, 2, 2, 149]], [*"abcde", "noise"], 4981, 0.049702, 9849),
    "hard graph": ([[2851, 288, 211, 737, 194, 3905], [2603, 548, 374, 169, 735, 2999], [2655, 220, 171, 141, 168, 3741], [1576, 841, 526, 119, 111, 1859], [1103, 54, 54, 115, 54, 878]], [*"abcde", "noise"], 3743, 0.012753, 8283),
    "hard density": ([[8091, 94, 1, 0, 0], [7339, 84, 5, 0, 0], [7033, 61, 2, 0, 0], [4975, 56, 1, 0, 0], [2240, 17, 1, 0, 0]], list("abcde"), 8177, -0.000198, 8177),
}


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_metrics(spark, case):
    table, pred, tp, ari, best = GOLDEN[case]
    pairs = evaluate.pairs_of(spark, table, TRUE, pred).persist()
    rows = {r["Class"]: r for r in evaluate.class_metrics(pairs, case).collect()}
    n = sum(map(sum, table))
    assert rows["Total"]["True_Positives"] == tp and rows["Total"]["False_Positives"] == rows["Total"]["False_Negatives"] == n - tp
    assert abs(rows["Total"]["Precision"] - tp / n) < 1e-12
    assert abs(evaluate.adjusted_rand_index(pairs).first()[0] - ari) < 1e-6
    t = np.array(table)
    assert sum(t[i, j] for j, i in enumerate(evaluate.optimal_map(t)) if i is not None) == best


def test_oracles(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")

    def norm(v):
        return None if v is None or v != v else round(v, 5) if isinstance(v, float) else v

    for name in ("stratified_sample", "mean_intra_cluster_distance", "knn_neighbors", "hybrid_mix", "cluster_metrics", "silhouette", "adjusted_rand_index", "pearson_residuals", "top_genes_with_ties", "marker_rank_sum"):
        df = queries.QUERIES[name](spark, DATA)
        r = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted((tuple(map(norm, x)) for x in r.fetchall()), key=repr) == sorted((tuple(norm(x[c]) for c in columns) for x in df.collect()), key=repr), name


def test_assignment_and_information():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(20):
        c = rng.integers(0, 50, (5, 5)).astype(float)
        assert sum(c[i, j] for i, j in enumerate(evaluate.assignment(c))) == min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5)))
    assert abs(evaluate.mutual_information(np.diag([5, 7, 3])) - 1) < 1e-12
    assert abs(evaluate.mutual_information(np.full((3, 3), 10))) < 0.05
    wide = np.array([[5, 0, 1, 0], [0, 6, 0, 2]])
    assert evaluate.optimal_map(wide) == [0, 1, None, None]


def test_seeded_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    draw = lambda d: sorted(d.select("id", uniform(1, "s", F.col("id")).alias("u")).collect())
    assert draw(df.repartition(2)) == draw(df.repartition(7))
    u = [r.u for r in draw(df)]
    assert 0.4 < np.mean(u) < 0.6 and min(u) >= 0 and max(u) < 1


def test_rounding_and_labels(spark):
    row = spark.range(1).select(half_even(F.lit(2.5)).alias("a"), half_even(F.lit(3.5)).alias("b"), rank_label(F.lit(2), 3).alias("c"), rank_label(F.lit(4), 3).alias("d")).first()
    assert tuple(row) == (2, 4, "cells_b", "noise")
    with pytest.raises(ValueError):
        rank_label(F.lit(1), 27)


def _cells(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "x": rng.integers(0, 30, n).astype(float), "y": rng.integers(0, 30, n).astype(float), "cluster": rng.integers(1, 4, n)}))


def test_blocks_match_brute_force(spark):
    cells = _cells(spark, 120)
    p = cells.toPandas().sort_values("cell_id")
    d = np.hypot(*(p[c].to_numpy()[:, None] - p[c].to_numpy()[None] for c in "xy"))
    near = spatial.neighbours(spatial.points(cells), spatial.points(cells), 5, block=32).toPandas()
    for i in range(120):
        row = d[i].copy()
        row[i] = np.inf
        assert near[near.id == i].sort_values("rank").dst.tolist() == np.lexsort((np.arange(120), row))[:5].tolist()
    sums = spatial.cluster_distances(spatial.points(cells), 32).toPandas()
    for i in (0, 50, 119):
        for h in (1, 2, 3):
            assert abs(sums[(sums.id == i) & (sums.h == str(h))].total.iloc[0] - d[i][p.cluster == h].sum()) < 1e-9


def test_edges_of_spatial_operators(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1)], "cell_id long, x double, y double, cluster int")
    assert spatial.silhouette(one).first()["silhouette"] is None
    maps = spatial.spatial_maps(one).first()
    assert maps["dispersion"] == 2.75 and maps["mean_dist"] == 0
    assert spatial.knn(one).count() == 0
    assert spatial.knn(one.limit(0)).count() == 0


def test_gene_edges(spark):
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (1, 2, 3), (2, 2, 5)], "cell_id long, gene_id int, count long").withColumn("cluster", F.lit(1))
    s = {r.gene_id: r for r in stats.gene_stats(e).collect()}
    assert s[1].cv_expr is None and s[1].zero_frac == 1 and s[2].mean_expr == 4
    assert {r.gene_id for r in stats.expressed(e).collect()} == {2}
    fit = {r.gene_id: r for r in stats.fit_negative_binomial(e).collect()}
    assert fit[1]["size"] is None and fit[2]["mu"] == 4
    assert stats.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)


def test_simulation(spark):
    rng = np.random.default_rng(3)
    n = 40
    x, y = np.meshgrid(np.arange(1, n + 1), np.arange(1, n + 1))
    value = np.clip((x // 9) / 5 + rng.normal(0, 0.01, x.shape), 0, 1)
    pixels = spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "value": value.ravel()}))
    out = simulate.simulate(pixels, Params(n_cells=300, n_genes=30, k=3, difficulty="easy"))
    cells, counts = out["cells"].toPandas(), out["expression"].toPandas()
    assert abs(len(cells) - 300) <= 3 and len(counts) == len(cells) * 30 and (counts["count"] >= 0).all()
    e = out["expression"].join(out["cells"].select("cell_id", "cluster"), "cell_id")
    own = {r.gene_id: r.cluster for r in stats.specificity(e).collect()}
    assert sum(own[g] == (g - 1) // 10 + 1 for g in range(1, 31)) >= 20  # markers stand out
    with pytest.raises(ValueError):
        Params(difficulty="none").resolved()
    assert simulate.marker_profile(spark, 5, 12, 5, 1.0, 0.0).where("cluster > 3 and mu > 2").count() == 0


def test_draws_have_the_right_moments(spark):
    rows = spark.range(4000).select(F.col("id").alias("cell_id"), F.lit(1).alias("gene_id"), F.lit(2.0).alias("mu"), F.lit(2.0).alias("dispersion"), F.lit(False).alias("stable"))
    c = simulate.draw_counts(rows, 1).toPandas()["count"]
    m = np.exp(2)
    assert abs(c.mean() - m) < 0.5 and abs(c.var() - (m + m * m / 2)) < 6
    c = simulate.draw_counts(rows.withColumn("stable", F.lit(True)), 1, "preserve").toPandas()["count"]
    assert abs(c.mean() - m) < 0.3


def test_planted_clusters_are_found(spark):
    rng = np.random.default_rng(0)
    label = np.repeat([0, 1, 2], 60)
    v = rng.normal(0, 0.4, (180, 2)) + np.array([[0, 0], [6, 0], [0, 6]])[label]
    scores = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(180), "v": v.tolist()}), "cell_id long, v array<double>")
    for found in (preprocess.communities(scores, 0.5, 20), preprocess.density_clusters(scores, 7)):
        p = found.toPandas().sort_values("cell_id").community.to_numpy()
        pairs = spark.createDataFrame(pd.DataFrame({"true": label.astype(str), "pred": p.astype(str)}))
        assert evaluate.adjusted_rand_index(pairs).first()[0] > 0.9


def test_bundle_and_policies(spark, tmp_path):
    cells = _cells(spark, 90, 5)
    counts = cells.select("cell_id", "cluster").withColumn("gene_id", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("count", F.when((F.col("gene_id") - 1) / 4 == F.col("cluster") - 1, 20).otherwise(2) + F.floor(uniform(1, "n", F.col("cell_id"), F.col("gene_id")) * 3)).withColumn("count", F.when(F.floor((F.col("gene_id") - 1) / 4) == F.col("cluster") - 1, F.col("count") + 20).otherwise(F.col("count")).cast("long")).select("cell_id", "gene_id", "count")
    sources.write_bundle({"cells": cells, "expression": counts}, str(tmp_path / "b"))
    bundle = sources.read_bundle(spark, str(tmp_path / "b"), "cells", "expression")
    labels, flat = plans.clustered(bundle, resolution=0.5, dims=3)
    labels = labels.persist()
    assert flat.count() == 90
    rows = plans.compare_clusters(labels, 3, "optimal").where("Class = 'Total' and Method = 'graph_optimal'").collect()
    assert rows[0]["Precision"] > 0.95
    assert plans.compare_clusters(labels, 3, "label_free").count() == 2
    assert plans.compare_clusters(labels, 3).count() >= 8
    sources.write_csv(plans.compare_clusters(labels, 3), str(tmp_path / "c"))
    assert sources.output_name("/a/b.rds", "_x", ".csv") == "/a/b_x.csv"
    assert set(compare.diagnostics(cells, counts)) >= {"spatial", "heatmap", "density"}
    with pytest.raises(ValueError):
        sources.require(cells, "nothing")


def test_layout_checks_its_limit_first(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "DRIVER_LIMIT", 3)
    monkeypatch.setattr(spatial, "neighbours", lambda *_: pytest.fail("neighbours before the limit"))
    with pytest.raises(ValueError, match="more than 3 rows"):
        preprocess.layout(spark.range(5).select(F.col("id").alias("cell_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")))


def test_compare_spatial_takes_all_cells(spark):
    cells = spark.range(1200).select(F.col("id").alias("cell_id"), (F.col("id") * F.col("id") % 1201).cast("double").alias("x"), (F.col("id") * 7 % 1201).cast("double").alias("y"))
    got = {r["dataset"]: r for r in compare.compare_spatial(cells, cells.where("cell_id < 30")).collect()}
    p = cells.toPandas()[["x", "y"]]
    z = ((p - p.mean()) / p.std()).to_numpy()
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    far = d[~np.eye(len(d), dtype=bool)]
    assert np.isclose(got["simulated"]["nn_dist"], np.sort(d, 1)[:, 1:6].mean()) and np.isclose(got["simulated"]["mean_dist"], far.mean()) and np.isclose(got["simulated"]["sd_dist"], far.std(ddof=1))


def test_simulate_counts_is_registered_at_full_size(spark):
    pixels = simulate.threshold(queries._pixels(spark, DATA)).count()
    got = queries.simulate_counts(spark, DATA).agg(F.count_distinct("cell_id").alias("c"), F.count_distinct("gene_id").alias("g")).first()
    assert (got["c"], got["g"]) == (min(pixels, Params().n_cells), Params().n_genes)


def test_neighbours_by_tree(spark):
    """Skewed points, many of them equal: exactly the neighbours of brute force, ties to the lesser id, from few pairs of leaves."""
    rng = np.random.default_rng(5)
    n = 1500
    x, y = rng.normal(size=(2, n)) ** 3
    x[:400], y[:400] = 1.0, 1.0
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "x": x, "y": y, "cluster": 1}))
    near = spatial.neighbours(spatial.points(cells), spatial.points(cells), 4, block=64).toPandas().sort_values(["id", "rank"])
    d = np.sqrt((x[:, None] - x[None]) ** 2 + (y[:, None] - y[None]) ** 2)
    np.fill_diagonal(d, np.inf)
    best = [np.lexsort((np.arange(n), row))[:4].tolist() for row in d]
    assert near.groupby("id").dst.agg(list).tolist() == best
    tree = spatial.Tree(np.stack([x, y], 1), 64)
    _, leaf = tree.find(np.stack([x, y], 1), np.full(n, -1.0))
    _, all_near = tree.find(np.stack([x, y], 1), np.sort(d, 1)[:, 3])
    assert len(leaf) == n and len(np.unique(leaf)) > 10 and len(all_near) < 5 * n
    other = spark.createDataFrame([(7, 0.5, 0.5, 1)], "cell_id long, x double, y double, cluster int")
    few = spatial.neighbours(spatial.points(other), spatial.points(cells), 3, same=False, block=64).toPandas()
    assert few.sort_values("rank").dst.tolist() == np.lexsort((np.arange(n), np.hypot(x - 0.5, y - 0.5)))[:3].tolist()


def test_distances_within_clusters(spark):
    cells = _cells(spark, 300)
    p = cells.toPandas().sort_values("cell_id")
    d = np.hypot(*(p[c].to_numpy()[:, None] - p[c].to_numpy()[None] for c in "xy"))
    same = p.cluster.to_numpy()[:, None] == p.cluster.to_numpy()[None]
    got = spatial.mean_intra_distance(cells).toPandas().sort_values("cell_id").mean_dist
    assert np.allclose(got, (d * same).sum(1) / same.sum(1))


def test_local_density_has_a_limit(spark, monkeypatch):
    cells = _cells(spark, 200)
    p = cells.toPandas().sort_values("cell_id")
    d = np.hypot(*(p[c].to_numpy()[:, None] - p[c].to_numpy()[None] for c in "xy"))
    expected = (d < np.quantile(d, 0.1, axis=1)[:, None]).mean(1)
    assert np.allclose(spatial.local_density(cells).toPandas().sort_values("cell_id").density, expected)
    monkeypatch.setattr(spatial, "BROADCAST", 100)
    with pytest.raises(ValueError):
        spatial.local_density(cells)


def test_ranks_and_numbers_without_one_task(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "v": rng.integers(0, 50, 400).astype(float)})).repartition(5)
    ranks = stats.average_rank(df, "v", "r").toPandas().sort_values("id")
    assert np.allclose(ranks.r, ranks.v.rank())
    numbers = stats.numbered(df, "n", "v", "id").toPandas().sort_values(["v", "id"])
    assert numbers.n.tolist() == list(range(1, 401))


def test_images(spark, tmp_path):
    """Pixel rows of written images: grey, colour, and colour with an alpha channel."""
    import struct
    import zlib

    def png(name, kind, pixels):
        part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
        rows = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
        path = tmp_path / name
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))
        return str(path)

    read = lambda path: {(r.x, r.y): r.value for r in sources.read_image(spark, path).collect()}
    grey = read(png("g.png", 0, [[(0,), (51,), (255,)], [(102,), (153,), (204,)]]))
    assert grey == {(x + 1, y + 1): pytest.approx(v / 255) for y, row in enumerate([[0, 51, 255], [102, 153, 204]]) for x, v in enumerate(row)}
    colours = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]]
    expected = {(1, 1): 0.3, (2, 1): 0.59, (1, 2): 0.11, (2, 2): 1.0}
    assert read(png("c.png", 2, colours)) == {k: pytest.approx(v) for k, v in expected.items()}
    assert read(png("a.png", 6, [[(*c, 255) for c in row] for row in colours])) == {k: pytest.approx(v) for k, v in expected.items()}
    with pytest.raises(ValueError):
        sources.read_image(spark, None)


def test_outputs(spark, tmp_path):
    sources.make_folder(f"{tmp_path}/out/deep")
    sources.write_text(["one", "two"], f"{tmp_path}/out/a.txt")
    sources.write_csv(spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double").coalesce(1), f"{tmp_path}/out/b.csv")
    assert sources.list_outputs(f"{tmp_path}/out") == ["a.txt", "b.csv", "deep"] and sources.list_outputs(f"{tmp_path}/out", "*.csv") == ["b.csv"] and sources.list_outputs(f"{tmp_path}/none") == []
    back = spark.read.option("header", True).option("nullValue", "NA").csv(f"{tmp_path}/out/b.csv")
    assert sorted(map(tuple, back.collect())) == [("a", "1.5"), ("b", None)]
    assert any("NA" in x.read_text() for x in (tmp_path / "out/b.csv").glob("part-*"))
    df = spark.createDataFrame([(1, 2, 3, 4)], "cell_id int, score_a int, score_b int, other int")
    assert sources.starting_with(df, "score_", "cell_id").columns == ["cell_id", "score_a", "score_b"]


def test_null_labels_are_left_out(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "y")], "true string, pred string")
    assert sorted(map(tuple, evaluate.contingency(pairs).collect())) == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]
    assert evaluate.adjusted_mutual_information(pairs).first()[0] == pytest.approx(1.0) and evaluate.adjusted_rand_index(pairs).first()[0] == 1.0


def test_log_factorials():
    import math

    n = np.array([0, 1, 2, 10, 255, 256, 1000, 10**6, 10**9])
    assert np.allclose(evaluate.log_factorial(n), [math.lgamma(x + 1) for x in n.tolist()], rtol=1e-13)


def test_validation(spark, tmp_path):
    """Six figures of a simulated against a reference dataset, the reduced validation and its files."""
    paths = []
    for seed in (1, 2):
        pixels = spark.createDataFrame(pd.DataFrame([(x, y, ((x // 10) % 3) / 4 + 0.05) for x in range(1, 31) for y in range(1, 8)], columns=["x", "y", "value"]))
        out = plans.simulate_spatial_counts(spark, pixels=pixels, output_path=f"{tmp_path}/{seed}", n_cells=150, n_genes=30, k=3, seed=seed, difficulty="easy")
        assert out["cells"].count() > 100
        paths.append(f"{tmp_path}/{seed}")
    rows = {r.test: r.value for r in plans.validate(spark, *paths, f"{tmp_path}/summary.csv").collect()}
    assert list(rows) == ["Silhouette (sim)", "Silhouette (ref)", "ARI (sim vs original)", "N clusters (sim)", "N clusters (ref)", "Dropout-distance p-value"]
    assert rows["ARI (sim vs original)"] > 0.1 and rows["N clusters (sim)"] >= 2 and 0 <= rows["Dropout-distance p-value"] <= 1
    parts = plans.validate_reduced(spark, *paths, f"{tmp_path}/reduced")
    assert sources.list_outputs(f"{tmp_path}/reduced") == ["correlation_of_correlations.txt", "expression_stats.csv"]
    assert parts["expression"].count() == 60 and -1 <= parts["similarity"].first()["rho"] <= 1
    matrix = parts["correlations"].toPandas()
    n = matrix[matrix.Dataset == "SIM"].Gene1.nunique()
    assert len(matrix) == 2 * n * n and (matrix[matrix.Gene1 == matrix.Gene2].Corr == 1).all()
    sides = [spark.read.parquet(f"{p}/expression").join(spark.read.parquet(f"{p}/cells").select("cell_id", "cluster"), "cell_id") for p in paths]
    per, changes = compare.compare_markers(*sides)
    assert {r.dataset for r in per.collect()} == {"SIM", "REF"} and changes.count() == per.agg(F.sum("n_markers")).first()[0]
    scores, _ = preprocess.pca(preprocess.log_normalize(sides[0]), "value", 4)
    sd = [r.sd for r in preprocess.elbow(scores).orderBy("component").collect()]
    assert len(sd) == 4 and sd == sorted(sd, reverse=True)


def _pairs(spark, a, b):
    return evaluate.adjusted_rand_index(spark.createDataFrame(pd.DataFrame({"true": np.asarray(a).astype(str), "pred": np.asarray(b).astype(str)}))).first()[0]


def test_neighbours_and_distances_in_many_dimensions():
    """Products of matrices bound the neighbours; these and close distances come out as component by component."""
    rng = np.random.default_rng(1)
    for case in ("plain", "copies", "large", "broken", "far from zero", "ties"):
        u, v = rng.normal(size=(50, 20)), rng.normal(size=(700, 20))
        if case == "copies":
            v = np.repeat(v[:100], 7, 0)
        if case == "large":
            u, v = u * 1e180, v * 1e180
        if case == "broken":
            v[::3], u[1], v[5, 0] = np.nan, np.inf, np.inf
        if case == "far from zero":
            u, v = u * 1e-3 + 1e6, v * 1e-3 + 1e6
        if case == "ties":
            u = v[:50] = np.round(u)
        ids, own = rng.permutation(700), np.arange(50)
        with np.errstate(all="ignore"):
            d = np.zeros((50, 700))
            for k in range(20):
                d += (u[:, k, None] - v[None, :, k]) ** 2
            d = np.sqrt(d)
        assert np.allclose(spatial.Block(v).distances(u), d, rtol=1e-9, atol=0, equal_nan=True), case
        d[own, own], d[np.isnan(d)] = np.inf, np.inf
        row, col, dist = spatial.Block(v, True).nearest(u, 5, ids, (own, own))
        assert list(zip(row.tolist(), col.tolist(), dist.tolist(), strict=True)) == [(i, j, d[i, j]) for i in range(50) for j in np.lexsort((ids, d[i]))[:5].tolist() if np.isfinite(d[i, j])], case


def test_communities_of_many_cells(spark):
    """Planted groups, numbers with gaps, a node without edges; more cells are taken than before; loops of merged nodes count in their degree."""
    rng = np.random.default_rng(3)
    n, group = 4_000, 100
    a = np.repeat(np.arange(n), 4)
    b = np.where(rng.random(len(a)) < 0.95, a // group * group + rng.integers(0, group, len(a)), rng.integers(0, n, len(a)))
    edges = pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "weight": 1.0}).query("src < dst").drop_duplicates()
    nodes = np.arange(n) * 3
    label = preprocess.louvain(edges.assign(src=edges.src * 3, dst=edges.dst * 3), nodes, 1.0)
    assert _pairs(spark, np.arange(n) // group, label) > 0.9 and preprocess.DRIVER_LIMIT > 102_564
    # two triangles and a bridge: modularity parts them
    small = pd.DataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0), (2, 3, 1.0)], columns=["src", "dst", "weight"])
    found = preprocess.louvain(small, np.arange(7), 1.0)
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5] and found[6] == 2


def test_spanning_tree_without_all_pairs(spark):
    """The tree of Kruskal over all pairs, copies and ties among them; more points are taken than before."""
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(300, 2)), np.repeat(rng.normal(size=(100, 2)), 4, 0), np.round(rng.normal(size=(400, 2)), 1), rng.normal(size=(200, 5))):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = np.sort(d, 1)[:, 6]
        reach = np.maximum(d, np.maximum(core[:, None], core[None]))
        i, j = np.triu_indices(len(x), 1)
        part, expected = np.arange(len(x)), []
        for k in np.lexsort((j, i, reach[i, j])):
            a, b = part[i[k]], part[j[k]]
            if a != b:
                part[part == a] = b
                expected.append((reach[i[k], j[k]], i[k], j[k]))
        assert preprocess.spanning_tree(x, core, chunk=64) == expected
    x = np.concatenate([rng.normal(size=(1_500, 2)), rng.normal(size=(1_000, 2)) + 50])
    tree = preprocess.spanning_tree(x, np.zeros(len(x)))
    assert preprocess.DRIVER_LIMIT > 102_564 and len(tree) == len(x) - 1 and sum(a < 1_500 <= b for _, a, b in tree) == 1


def test_layout_parts_clusters(spark):
    rng = np.random.default_rng(4)
    n = 300
    at = np.repeat([0.0, 2.0], n // 2) + rng.random(n) / 4
    scores = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "x": np.cos(at), "y": np.sin(at)})).select("cell_id", F.array("x", "y").alias("v"))
    y = np.stack(preprocess.layout(scores).toPandas().sort_values("cell_id")["v"])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert ((d.argmin(1) < 150) == (np.arange(n) < 150)).mean() > 0.95 and preprocess.DRIVER_LIMIT > 102_564


def test_edges_from_neighbours(spark):
    """The edges made from arrays are those of the table, whatever the size of a chunk."""
    rng = np.random.default_rng(5)
    n = 300
    v = np.concatenate([rng.normal(size=(n - 40, 3)), np.zeros((40, 3))])
    scores = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "v": v.tolist()}), "cell_id long, v array<double>")
    p = scores.select(F.col("cell_id").alias("id"), "v", F.lit("0").alias("g"))
    near = spatial.neighbours(p, p, 9).toPandas()
    expected = [tuple(r) for r in preprocess.snn_edges(scores, 10).orderBy("src", "dst").collect()]
    for chunk in (1, 500, 1 << 20):
        src, dst, w = preprocess.shared_edges(near["id"].to_numpy(), near["dst"].to_numpy(), n, chunk=chunk)
        assert list(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True)) == expected and len(expected) > n
    assert [len(x) for x in preprocess.shared_edges(np.zeros(0, int), np.zeros(0, int), 0)] == [0, 0, 0]


def test_batches_of_moves_are_as_good(monkeypatch):
    """Moves that begin with batches reach the modularity of single moves on a graph without clear groups, and visit few nodes one by one."""
    rng = np.random.default_rng(6)
    n = 3_000
    x = rng.normal(size=(n, 8))
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:15]
    src, dst, w = preprocess.shared_edges(np.repeat(np.arange(n), 14), near.ravel(), n)
    degree = np.bincount(src, w, n) + np.bincount(dst, w, n)

    def score(seed):
        label = preprocess.louvain(pd.DataFrame({"src": src, "dst": dst, "weight": w}), np.arange(n), 1.0, seed)
        return 2 * w[label[src] == label[dst]].sum() / degree.sum() - ((np.bincount(label, degree) / degree.sum()) ** 2).sum()

    batched = np.mean([score(s) for s in range(4)])
    monkeypatch.setattr(preprocess, "BATCHED", n + 1)
    assert batched > np.mean([score(s) for s in range(4)]) - 0.01


def test_components_are_centred(spark):
    """Scores are those of centred values, from vectors that are made once."""
    x = np.random.default_rng(7).normal(size=(40, 6)) * np.arange(1, 7) + 100
    rows = spark.createDataFrame(pd.DataFrame([(i, g, x[i, g]) for i in range(40) for g in range(6)], columns=["cell_id", "gene_id", "value"]))
    scores, model = preprocess.pca(rows, "value", 3)
    got = np.stack(scores.orderBy("cell_id").toPandas()["v"])
    assert np.allclose(got, (x - x.mean(0)) @ model.pc.toArray()) and "InMemoryTableScan" in scores._jdf.queryExecution().executedPlan().toString()


def test_silhouettes_of_many_clusters(spark, monkeypatch):
    """Against brute force: clusters of one, a cluster cut into parts, one with a block of its own; a block answers with one row for each point."""
    rng = np.random.default_rng(8)
    n = 400
    g = np.where(rng.random(n) < 0.5, 0, np.where(rng.random(n) < 0.5, 1, rng.integers(2, 60, n)))
    u, own, count = np.unique(g, return_inverse=True, return_counts=True)
    monkeypatch.setattr(spatial, "TILE", (16, 32))
    monkeypatch.setattr(spatial, "cluster_distances", lambda *_, **__: pytest.fail("a row for each point and cluster"))
    for x in (rng.normal(size=(n, 2)), rng.normal(size=(n, 6))):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        sums = np.stack([d[:, g == c].sum(1) for c in u], 1)
        mean = sums / count
        mean[np.arange(n), own] = np.inf
        rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": x.tolist(), "g": g.astype(str)}))
        for block in (None, (40, 64), (500, 100)):
            got = spatial.cluster_nearness(rows, block).toPandas().sort_values("id")
            assert len(got) == n and (got["size"] == count[own]).all()
            assert np.allclose(got["total"], sums[np.arange(n), own]) and np.allclose(got["b"], mean.min(1))
        cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "cluster": g} | {f"c{i}": x[:, i] for i in range(x.shape[1])}))
        s = spatial.silhouette(cells, columns=tuple(f"c{i}" for i in range(x.shape[1]))).toPandas().sort_values("cell_id")["silhouette"].to_numpy()
        size, b = count[own], mean.min(1)
        a = sums[np.arange(n), own] / np.maximum(size - 1, 1)
        assert np.allclose(s, np.where(size == 1, 0.0, (b - a) / np.maximum(a, b)))
    left = spatial.cluster_nearness(rows.withColumn("g", F.expr("if(id = 3, null, g)")))
    assert left.count() == n - 1
