"""Queries over the relational test tables, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import half_even
from tessera.operators import compare, evaluate, preprocess, simulate, spatial, stats
from tessera.schema import Params

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables of the adapters in SQL.
_WITH = """WITH expr AS (SELECT vec_id AS cell_id, label AS cluster, g AS gene_id, CAST(floor(greatest(CAST(embedding[g] AS DOUBLE), 0) * 100) AS BIGINT) AS count
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS g FROM embeddings)),
cells AS (SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS cluster FROM embeddings),
pixels AS (SELECT event_id, event_id % 100 + 1 AS x, event_id // 100 + 1 AS y, least(value / 100, 1) AS value, event_type FROM events),
labelled AS (SELECT CAST(label AS VARCHAR) AS t, CAST(vec_id % 7 AS VARCHAR) AS p FROM embeddings),
pairs AS (SELECT a.cell_id, a.cluster, b.cell_id AS dst, b.cluster AS d, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM cells a, cells b),
near AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, dst) AS r FROM pairs WHERE cell_id <> dst),
gstats AS (SELECT gene_id, avg(count) AS m, var_samp(count) AS v, stddev_samp(count) AS s, avg(CAST(count = 0 AS INT)) AS z, CAST(sum(count) AS BIGINT) AS t FROM expr GROUP BY gene_id),
means AS (SELECT cluster, gene_id, avg(count) AS m FROM expr GROUP BY ALL),
spec AS (SELECT gene_id, arg_min(cluster, (-m, cluster)) AS cluster, max(m) - coalesce((sum(m) - max(m)) / nullif(count(*) - 1, 0), 0) AS s FROM means GROUP BY gene_id),
u AS (SELECT 1)
"""
_DRAW = "CAST(('0x' || substr(md5('{seed}|{stream}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"


def draw(seed: int, stream: str, key: str) -> str:
    return _DRAW.format(seed=seed, stream=stream, key=key)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cells(spark, sf):
    return sources.cells(_t(spark, sf, "embeddings"))


def _expr(spark, sf):
    return sources.expression(_t(spark, sf, "embeddings"))


def _pixels(spark, sf):
    return sources.pixels(_t(spark, sf, "events"))


def _labelled(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("label").cast("string").alias("true"), (F.col("vec_id") % 7).cast("string").alias("pred"))


def _parts(spark, sf):
    return _t(spark, sf, "part").select(F.col("p_brand").alias("true"), F.col("p_type").alias("pred"))


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query("SELECT event_id, x, y, value FROM pixels WHERE value < 0.7")
def pixel_threshold(spark, sf):
    return simulate.threshold(_pixels(spark, sf)).select("event_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value")


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM pixels GROUP BY event_type")
def pixel_intensity_summary(spark, sf):
    return _pixels(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS freq, round(n * 100 / sum(n) OVER (), 6) AS pct FROM (SELECT event_type, count(*) AS n FROM pixels GROUP BY event_type)")
def cluster_proportions(spark, sf):
    return stats.frequencies(_pixels(spark, sf), "event_type").select("event_type", "n", *r6("freq", "pct"))


@query("SELECT event_type, CAST(least(round_even(n / sum(n) OVER () * 777, 0), n) AS BIGINT) AS quota FROM (SELECT event_type, count(*) AS n FROM pixels GROUP BY event_type)")
def stratum_quota(spark, sf):
    return stats.frequencies(_pixels(spark, sf), "event_type").select("event_type", F.least(half_even(F.col("freq") * 777), F.col("n")).alias("quota"))


@query(f"""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {draw(123, "sample", "event_id")}, event_id) AS r FROM pixels)
JOIN (SELECT event_type, least(round_even(n / sum(n) OVER () * 777, 0), n) AS quota FROM (SELECT event_type, count(*) AS n FROM pixels GROUP BY event_type)) USING (event_type) WHERE r <= quota""")
def stratified_sample(spark, sf):
    return stats.quota_sample(_pixels(spark, sf), "event_type", "event_id", 777).select("event_id", "event_type")


@query(f"SELECT cell_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {draw(42, 'cap', 'cell_id')}, cell_id) AS r FROM cells) WHERE r <= 20")
def group_cap_sample(spark, sf):
    return stats.cap_sample(_cells(spark, sf), "cluster", "cell_id", 20).select("cell_id", "cluster")


@query(f"SELECT cell_id FROM cells ORDER BY {draw(123, 'rows', 'cell_id')}, cell_id LIMIT 50")
def uniform_sample(spark, sf):
    return stats.uniform_sample(_cells(spark, sf), "cell_id", 50).select("cell_id")


@query("""SELECT CAST(c AS INT) AS cluster, CAST(g AS INT) AS gene_id, round(2 + CASE WHEN g > (c - 1) * 5 AND g <= c * 5 THEN 0.8 ELSE 0 END + CASE WHEN c > 1 AND g > (c - 2) * 5 AND g <= (c - 1) * 5 THEN 0.4 ELSE 0 END, 6) :: DOUBLE AS mu
FROM range(1, 6) a(c), range(1, 101) b(g)""")
def marker_profile(spark, sf):
    return simulate.marker_profile(spark, 5, 100, 5, 0.8, 0.4).select("cluster", "gene_id", *r6("mu"))


@query("SELECT cell_id, round(avg(dist), 6) AS mean_dist FROM pairs WHERE cluster = d GROUP BY cell_id")
def mean_intra_cluster_distance(spark, sf):
    return spatial.mean_intra_distance(_cells(spark, sf)).select("cell_id", *r6("mean_dist"))


@query("SELECT cell_id, round(avg(CAST(dist < cut AS INT)), 6) AS density FROM pairs JOIN (SELECT cell_id, quantile_cont(dist, 0.1) AS cut FROM pairs GROUP BY cell_id) USING (cell_id) GROUP BY cell_id")
def local_density(spark, sf):
    return spatial.local_density(_cells(spark, sf)).select("cell_id", *r6("density"))


@query("SELECT cell_id, CAST(sum(CAST(cell_id <> dst AND dist <= 0.5 AS INT)) AS BIGINT) AS n FROM pairs GROUP BY cell_id")
def radius_count(spark, sf):
    return spatial.radius_count(_cells(spark, sf), 0.5)


@query("""SELECT cell_id, round(m, 6) AS mean_dist, round(5 + (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * (0.5 - 5), 6) AS dispersion, round(0.1 + (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * 0.4, 6) AS dropout
FROM (SELECT cell_id, avg(dist) AS m FROM pairs WHERE cluster = d GROUP BY cell_id)""")
def rescale_dropout_dispersion(spark, sf):
    return spatial.spatial_maps(_cells(spark, sf)).select("cell_id", *r6("mean_dist", "dispersion", "dropout"))


@query("SELECT cell_id, dst, CAST(r AS INT) AS rank, round(dist, 6) AS dist FROM near WHERE r <= 19")
def knn_neighbors(spark, sf):
    return spatial.knn(_cells(spark, sf)).select("cell_id", "dst", "rank", *r6("dist"))


@query("SELECT cell_id, round(avg(dist), 6) AS mean_dist FROM near WHERE r <= 5 GROUP BY cell_id")
def knn_mean_distance(spark, sf):
    return spatial.knn_mean_distance(_cells(spark, sf)).select("cell_id", *r6("mean_dist"))


@query("SELECT cell_id AS src, arg_min(dst, (dist, dst)) AS dst FROM near WHERE r <= 19 AND cluster <> d GROUP BY cell_id")
def hybrid_pairs(spark, sf):
    return spatial.hybrid_pairs(_cells(spark, sf))


_HYBRID = f""", hp AS (SELECT cell_id AS src, arg_min(dst, (dist, dst)) AS dst FROM near WHERE r <= 19 AND cluster <> d GROUP BY cell_id),
hw AS (SELECT h.cell_id, c.cluster AS other, arg_max(weight, (src, way, o)) AS weight FROM (
  SELECT src AS cell_id, dst AS o, src, 0 AS way, 0.2 + {draw(123, "there", "src || '|' || dst")} * 0.3 AS weight FROM hp UNION ALL SELECT dst, src, src, 1, 0.2 + {draw(123, "back", "src || '|' || dst")} * 0.3 FROM hp) h
  JOIN cells c ON c.cell_id = h.o GROUP BY ALL)"""


@query(_HYBRID + "SELECT cell_id, other, round(weight, 6) AS weight FROM hw")
def hybrid_mix(spark, sf):
    c = _cells(spark, sf)
    return simulate.hybrid_weights(spatial.hybrid_pairs(c), c).select("cell_id", "other", *r6("weight"))


@query(_HYBRID + """, prof AS (SELECT CAST(c - 1 AS INT) AS cluster, CAST(g AS INT) AS gene_id, 2 + CAST(CASE WHEN g > (c - 1) * 2 AND g <= c * 2 THEN 0.8 ELSE 0 END + CASE WHEN c > 1 AND g > (c - 2) * 2 AND g <= (c - 1) * 2 THEN 0.4 ELSE 0 END AS DOUBLE) AS mu
FROM range(1, 11) a(c), range(1, 21) b(g)),
tails AS (SELECT *, coalesce(exp(sum(ln(1 - weight)) OVER (PARTITION BY cell_id ORDER BY other ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS tail FROM hw),
moved AS (SELECT h.cell_id, p.gene_id, exp(sum(ln(1 - weight))) AS w, sum(weight * tail * p.mu) AS s FROM tails h JOIN prof p ON p.cluster = h.other GROUP BY ALL)
SELECT c.cell_id, p.gene_id, round(CASE WHEN s IS NULL THEN p.mu ELSE w * p.mu + s END, 6) AS mu FROM cells c JOIN prof p USING (cluster) LEFT JOIN moved m ON m.cell_id = c.cell_id AND m.gene_id = p.gene_id""")
def hybrid_means(spark, sf):
    c = _cells(spark, sf)
    p = simulate.marker_profile(spark, 10, 20, 2, 0.8, 0.4).withColumn("cluster", F.col("cluster") - 1)
    base = c.join(F.broadcast(p), "cluster").select("cell_id", "gene_id", "mu")
    return simulate.hybrid_mix(base, simulate.hybrid_weights(spatial.hybrid_pairs(c), c), p).select("cell_id", "gene_id", *r6("mu"))


_CENTRE = ", centre AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM cells GROUP BY cluster), dc AS (SELECT cell_id, min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS d FROM cells, centre GROUP BY cell_id)"


@query(_CENTRE + "SELECT cell_id, round(d, 6) AS dist_to_center FROM dc")
def nearest_centroid(spark, sf):
    return spatial.nearest_centroid(_cells(spark, sf)).select("cell_id", *r6("dist_to_center"))


@query(_CENTRE + "SELECT round(regr_slope(z, d), 6) AS slope, round(regr_intercept(z, d), 6) AS intercept, round(regr_r2(z, d), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM dc JOIN (SELECT cell_id, avg(CAST(count = 0 AS INT)) AS z FROM expr GROUP BY cell_id) USING (cell_id)")
def dropout_vs_distance_regression(spark, sf):
    return compare.dropout_test(_expr(spark, sf), _cells(spark, sf)).select(*r6("slope", "intercept", "r2"), "n")


@query()
def regression_p_value(spark, sf):
    return compare.dropout_test(_expr(spark, sf), _cells(spark, sf)).select(*r6("t", "p_value"))


@query("""SELECT CAST(g.j * 10 + g.i AS BIGINT) AS id, round(sum(power(greatest(dist, 1e-12), -2) * value) / sum(power(greatest(dist, 1e-12), -2)), 6) AS z FROM (
SELECT g.i, g.j, c.cell_id, CAST(c.cluster AS DOUBLE) AS value, sqrt((c.x - gx) ** 2 + (c.y - gy) ** 2) AS dist, row_number() OVER (PARTITION BY g.i, g.j ORDER BY sqrt((c.x - gx) ** 2 + (c.y - gy) ** 2), c.cell_id) AS r FROM
(SELECT a.i, b.j, x0 + a.i * (x1 - x0) / 9 AS gx, y0 + b.j * (y1 - y0) / 9 AS gy FROM range(10) a(i), range(10) b(j), (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells)) g, cells c) g WHERE r <= 30 GROUP BY i, j""")
def idw_grid(spark, sf):
    return spatial.idw(_cells(spark, sf), "cluster", 10).select("id", *r6("z"))


@query(f"SELECT cell_id, gene_id, CASE WHEN {draw(123, 'dropout', "cell_id || '|' || gene_id")} < 0.3 THEN 0 ELSE count END AS count FROM expr")
def bernoulli_dropout(spark, sf):
    return simulate.bernoulli_dropout(_expr(spark, sf), F.lit(0.3)).select("cell_id", F.col("gene_id").cast("long").alias("gene_id"), "count")


@query("SELECT gene_id, round(m, 6) AS mean_expr, round(v, 6) AS var_expr, round(s / nullif(m, 0), 6) AS cv_expr, round(v / nullif(m * m, 0), 6) AS cv2, round(z, 6) AS zero_frac, t AS total FROM gstats")
def gene_stats(spark, sf):
    return stats.gene_stats(_expr(spark, sf)).select("gene_id", *r6("mean_expr", "var_expr", "cv_expr", "cv2", "zero_frac"), "total")


@query("SELECT gene_id, round(v / (m * m), 6) AS cv2 FROM gstats WHERE v / (m * m) < (SELECT quantile_cont(v / (m * m), 0.1) FROM gstats)")
def stable_genes(spark, sf):
    return stats.stable_genes(_expr(spark, sf)).select("gene_id", *r6("cv2"))


@query("SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_count, CAST(sum(CAST(count > 0 AS INT)) AS BIGINT) AS n_feature, round(avg(CAST(count = 0 AS INT)), 6) AS zero_frac FROM expr GROUP BY cell_id")
def cell_zero_fraction(spark, sf):
    return stats.cell_stats(_expr(spark, sf)).select("cell_id", "n_count", "n_feature", *r6("zero_frac"))


@query("SELECT gene_id, count(*) AS n FROM expr WHERE gene_id IN (SELECT gene_id FROM gstats WHERE t > 0) GROUP BY gene_id")
def expressed_genes(spark, sf):
    return stats.expressed(_expr(spark, sf)).groupBy("gene_id").agg(F.count("*").alias("n"))


@query("SELECT cluster, gene_id, round(m, 6) AS mean_expr FROM means")
def cluster_profile(spark, sf):
    return stats.profile(_expr(spark, sf)).select("cluster", "gene_id", *r6("mean_expr"))


@query("SELECT gene_id, cluster, round(s, 6) AS specificity FROM spec")
def gene_specificity(spark, sf):
    return stats.specificity(_expr(spark, sf)).select("gene_id", "cluster", *r6("specificity"))


@query("SELECT gene_id, round(s, 6) AS specificity FROM spec ORDER BY s DESC, gene_id LIMIT 20")
def top_markers(spark, sf):
    return stats.top_n(stats.specificity(_expr(spark, sf)), "specificity", "gene_id", 20).select("gene_id", *r6("specificity"))


@query("SELECT c.cluster, coalesce(gene_id, 1) AS gene_id FROM (SELECT DISTINCT cluster FROM expr) c LEFT JOIN (SELECT cluster, arg_min(gene_id, (-s, gene_id)) AS gene_id FROM spec GROUP BY cluster) USING (cluster)")
def representative_genes(spark, sf):
    return stats.representative_genes(_expr(spark, sf))


@query("SELECT cluster, gene_id, m AS count FROM (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY m DESC) AS r FROM (SELECT cluster, gene_id, CAST(sum(count) AS BIGINT) AS m FROM expr GROUP BY cluster, gene_id)) WHERE r <= 5")
def top_genes_with_ties(spark, sf):
    totals = _expr(spark, sf).groupBy("cluster", "gene_id").agg(F.sum("count").alias("count"))
    return stats.top_n_ties(totals, "cluster", "count", 5)


@query("SELECT cell_id, gene_id, round((count - avg(count) OVER w) / nullif(stddev_samp(count) OVER w, 0), 6) AS z FROM expr WINDOW w AS (PARTITION BY cell_id)")
def cell_zscore_long(spark, sf):
    return stats.cell_zscores(_expr(spark, sf)).select("cell_id", "gene_id", *r6("z"))


@query("SELECT a.gene_id AS g1, b.gene_id AS g2, round(corr(a.count, b.count), 6) AS r FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene_id < b.gene_id GROUP BY ALL")
def gene_correlation(spark, sf):
    return stats.gene_correlation(_expr(spark, sf)).select("g1", "g2", *r6("r"))


@query(""", tops AS (SELECT gene_id FROM expr WHERE cell_id % 2 = 0 GROUP BY gene_id ORDER BY sum(count) DESC, gene_id LIMIT 50)
SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS ra, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rb FROM (
SELECT a.gene_id AS g1, b.gene_id AS g2, corr(a.count, b.count) FILTER (WHERE a.cell_id % 2 = 0) AS r, corr(a.count, b.count) FILTER (WHERE a.cell_id % 2 = 1) AS q FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene_id < b.gene_id
WHERE a.gene_id IN (SELECT gene_id FROM tops) AND b.gene_id IN (SELECT gene_id FROM tops) GROUP BY ALL))""")
def correlation_of_correlations(spark, sf):
    e = _expr(spark, sf)
    return compare.correlation_of_correlations(e.where("cell_id % 2 = 0"), e.where("cell_id % 2 = 1")).select(*r6("rho"))


@query("""SELECT CAST(least(floor((count - lo) * 50.0 / (hi - lo)) + 1, 50) AS INT) AS bin, count(*) AS n FROM expr, (SELECT min(count) AS lo, max(count) AS hi FROM expr) GROUP BY bin""")
def count_histogram(spark, sf):
    return stats.histogram(_expr(spark, sf), "count")


@query("SELECT round(avg(dist), 6) AS mean_dist, round(stddev_samp(dist), 6) AS sd_dist, round(stddev_samp(dist) / avg(dist), 6) AS cv FROM pairs WHERE cell_id <> dst")
def distance_cv(spark, sf):
    return spatial.distance_summary(_cells(spark, sf)).select(*r6("mean_dist", "sd_dist", "cv"))


@query('SELECT t AS "true", p AS pred, count(l.t1) AS n FROM (SELECT DISTINCT t FROM labelled), (SELECT DISTINCT p FROM labelled) LEFT JOIN (SELECT t AS t1, p AS p1 FROM labelled) l ON t1 = t AND p1 = p GROUP BY ALL')
def contingency(spark, sf):
    return evaluate.contingency(_labelled(spark, sf))


@query('SELECT quality AS "true", toxic AS pred, count(*) AS n, CAST(grouping(quality, toxic) AS INT) AS "grouping" FROM labels GROUP BY CUBE (quality, toxic)')
def contingency_margins(spark, sf):
    return evaluate.margins(_t(spark, sf, "labels").select(F.col("quality").alias("true"), F.col("toxic").alias("pred")))


_RANKED = """, tr AS (SELECT t, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, t) <= 5 THEN 'cells_' || chr(96 + CAST(row_number() OVER (ORDER BY count(*) DESC, t) AS INT)) ELSE 'noise' END AS tn FROM labelled GROUP BY t),
pr AS (SELECT p, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, p) <= 5 THEN 'cells_' || chr(96 + CAST(row_number() OVER (ORDER BY count(*) DESC, p) AS INT)) ELSE 'noise' END AS pn FROM labelled GROUP BY p),
rk AS (SELECT tn, pn FROM labelled JOIN tr USING (t) JOIN pr USING (p)),
cl AS (SELECT c, (SELECT count(*) FROM rk WHERE tn = c AND pn = c) AS tp, (SELECT count(*) FROM rk WHERE tn = c) AS nt, (SELECT count(*) FROM rk WHERE pn = c) AS np FROM (SELECT tn AS c FROM rk UNION SELECT pn FROM rk))
"""


@query(_RANKED + "SELECT tn AS renamed, count(*) AS n FROM rk GROUP BY tn")
def size_rank_labels(spark, sf):
    return evaluate.size_rank_labels(_labelled(spark, sf), "true", 5).groupBy("renamed").agg(F.count("*").alias("n"))


@query(_RANKED + """, al AS (SELECT c AS "Class", CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(nt - tp AS BIGINT) AS fn FROM cl UNION ALL SELECT 'Total', CAST(sum(tp) AS BIGINT), CAST(sum(np - tp) AS BIGINT), CAST(sum(nt - tp) AS BIGINT) FROM cl)
SELECT 'mod7' AS "Method", "Class", tp AS "True_Positives", fp AS "False_Positives", fn AS "False_Negatives", tp / nullif(tp + fp, 0) AS "Precision" FROM al""")
def cluster_metrics(spark, sf):
    t = evaluate.size_rank_labels(_labelled(spark, sf), "true", 5, out="t")
    p = evaluate.size_rank_labels(t, "pred", 5, out="p").select(F.col("t").alias("true"), F.col("p").alias("pred"))
    return evaluate.class_metrics(p, "mod7")


_SIL = """, cd AS (SELECT cell_id, cluster, d, sum(dist) AS s, count(*) AS n FROM pairs GROUP BY ALL),
sil AS (SELECT o.cell_id, o.cluster, CASE WHEN o.n = 1 THEN 0 ELSE (b - o.s / (o.n - 1)) / greatest(b, o.s / (o.n - 1)) END AS w FROM cd o JOIN (SELECT cell_id, min(s / n) AS b FROM cd WHERE cluster <> d GROUP BY cell_id) USING (cell_id) WHERE o.cluster = o.d)
"""


@query(_SIL + "SELECT cell_id, CAST(cluster AS VARCHAR) AS cluster, round(w, 6) AS silhouette FROM sil")
def silhouette(spark, sf):
    return spatial.silhouette(_cells(spark, sf)).select("cell_id", "cluster", *r6("silhouette"))


@query(_SIL + "SELECT CAST(cluster AS VARCHAR) AS cluster, count(*) AS size, round(avg(w), 6) AS avg_width FROM sil GROUP BY cluster")
def silhouette_summary(spark, sf):
    return spatial.silhouette_summary(spatial.silhouette(_cells(spark, sf))).select("cluster", "size", *r6("avg_width"))


@query("""SELECT round((s - a * b / w) / ((a + b) / 2 - a * b / w), 6) AS ari FROM (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type)), (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)),
(SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT count(*) AS n FROM part GROUP BY p_type)), (SELECT count(*) * (count(*) - 1) / 2 AS w FROM part)""")
def adjusted_rand_index(spark, sf):
    return evaluate.adjusted_rand_index(_parts(spark, sf)).select(*r6("ari"))


@query()
def adjusted_mutual_information(spark, sf):
    return evaluate.adjusted_mutual_information(_parts(spark, sf)).select(*r6("ami"))


@query()
def optimal_assignment(spark, sf):
    return evaluate.optimal_assignment(_parts(spark, sf))


@query("""SELECT cell_id, gene_id, round(greatest(least(coalesce((count - mu) / nullif(sqrt(mu + mu * mu / 100), 0), 0), sqrt(n)), -sqrt(n)), 6) AS residual FROM (SELECT cell_id, gene_id, count, sum(count) OVER (PARTITION BY cell_id) * sum(count) OVER (PARTITION BY gene_id) / sum(count) OVER () AS mu, (SELECT count(*) FROM cells) AS n FROM expr)""")
def pearson_residuals(spark, sf):
    return preprocess.pearson_residuals(_expr(spark, sf)).select("cell_id", "gene_id", *r6("residual"))


@query("SELECT cell_id, gene_id, round(ln(1 + coalesce(count * 10000.0 / nullif(sum(count) OVER (PARTITION BY cell_id), 0), 0)), 6) AS value FROM expr")
def log_normalize(spark, sf):
    return preprocess.log_normalize(_expr(spark, sf)).select("cell_id", "gene_id", *r6("value"))


@query("""SELECT gene_id, round(v - a * m - b, 6) AS score FROM (SELECT gene_id, log10(m) AS m, log10(v) AS v FROM gstats WHERE m > 0 AND v > 0), (SELECT regr_slope(log10(v), log10(m)) AS a, regr_intercept(log10(v), log10(m)) AS b FROM gstats WHERE m > 0 AND v > 0) ORDER BY v - a * m - b DESC, gene_id LIMIT 20""")
def variable_genes(spark, sf):
    return preprocess.variable_genes(_expr(spark, sf), 20).select("gene_id", *r6("score"))


@query("SELECT cell_id, gene_id, round(coalesce((count - avg(count) OVER w) / nullif(stddev_samp(count) OVER w, 0), 0), 6) AS scaled FROM expr WINDOW w AS (PARTITION BY gene_id)")
def scale_genes(spark, sf):
    return preprocess.scale_genes(_expr(spark, sf), "count").select("cell_id", "gene_id", *r6("scaled"))


@query(""", own AS (SELECT cell_id AS id, dst FROM near WHERE r <= 9 UNION ALL SELECT cell_id, cell_id FROM cells)
SELECT a.id AS src, b.id AS dst, round(count(*) / (20.0 - count(*)), 6) AS weight FROM own a JOIN own b ON a.dst = b.dst AND a.id < b.id GROUP BY ALL HAVING count(*) / (20.0 - count(*)) >= 1.0 / 15""")
def snn_edges(spark, sf):
    return preprocess.snn_edges(_cells(spark, sf).select("cell_id", F.array("x", "y").alias("v")), 10).select("src", "dst", *r6("weight"))


@query("""SELECT cluster, gene_id, round(s - a * (a + 1) / 2, 6) AS u FROM (SELECT cluster, gene_id, sum(rk) AS s, count(*) AS a FROM (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY count) + (count(*) OVER (PARTITION BY gene_id, count) - 1) / 2 AS rk FROM expr) GROUP BY ALL)""")
def marker_rank_sum(spark, sf):
    return compare.marker_rank_sum(_expr(spark, sf)).select("cluster", "gene_id", *r6("u"))


@query(""", v AS (SELECT *, ln(1 + coalesce(count * 10000.0 / nullif(sum(count) OVER (PARTITION BY cell_id), 0), 0)) AS value FROM expr),
rk AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2 AS rnk FROM v),
tie AS (SELECT gene_id, sum(n * n * n - n) AS t, sum(n) AS al FROM (SELECT gene_id, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY gene_id, value) GROUP BY gene_id),
wh AS (SELECT gene_id, CAST(sum(CAST(count > 0 AS INT)) AS DOUBLE) AS p, sum(exp(value) - 1) AS s FROM v GROUP BY gene_id),
own AS (SELECT cluster, gene_id, CAST(sum(CAST(count > 0 AS INT)) AS DOUBLE) AS p, sum(exp(value) - 1) AS s, CAST(count(*) AS DOUBLE) AS n, sum(rnk) AS r FROM rk GROUP BY cluster, gene_id),
m AS (SELECT o.cluster, o.gene_id, o.p / n AS pct, (w.p - o.p) / (al - n) AS pr, log2(o.s / n + 1) - log2((w.s - o.s) / (al - n) + 1) AS fc,
  (r - n * (n + 1) / 2 - n * (al - n) / 2) / sqrt(n * (al - n) / 12 * (al + 1 - t / (al * (al - 1)))) AS z FROM own o JOIN wh w USING (gene_id) JOIN tie USING (gene_id))
SELECT cluster, gene_id, round(pct, 6) AS pct, round(fc, 6) AS avg_log2fc, round(z, 6) AS z FROM m WHERE greatest(pct, pr) >= 0.25 AND fc >= 0.25""")
def markers(spark, sf):
    return compare.markers(_expr(spark, sf)).select("cluster", "gene_id", *r6("pct", "avg_log2fc", "z"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL")
def group_statistics(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.try_divide(F.stddev_samp("l_quantity"), F.avg("l_quantity")), 6).alias("cv"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 6).alias("p90"))


@query("SELECT gene_id, 'A' AS dataset, round(avg(count), 6) AS mean_expr FROM expr WHERE cluster < 5 GROUP BY gene_id UNION ALL SELECT gene_id, 'B', round(avg(count), 6) FROM expr WHERE cluster >= 5 GROUP BY gene_id")
def stacked_gene_means(spark, sf):
    e = _expr(spark, sf)
    side = lambda part, name: part.groupBy("gene_id").agg(F.round(F.avg("count"), 6).alias("mean_expr")).withColumn("dataset", F.lit(name))
    return side(e.where("cluster < 5"), "A").unionByName(side(e.where("cluster >= 5"), "B"))


@query("SELECT cell_id, name, value FROM cells UNPIVOT (value FOR name IN (x, y))")
def unpivot_coordinates(spark, sf):
    return _cells(spark, sf).unpivot("cell_id", ["x", "y"], "name", "value")


_SIDE = """SELECT 'gene-' || gene_id AS gene, '{name}' AS dataset, round(avg(count), 6) AS mean_expr, round(var_samp(count), 6) AS var_expr, round(stddev_samp(count) / nullif(avg(count), 0), 6) AS cv_expr, round(avg(CAST(count = 0 AS INT)), 6) AS zero_frac
FROM expr WHERE cluster {part} AND gene_id IN (SELECT gene_id FROM picked) GROUP BY gene_id"""


@query(f", picked AS (SELECT gene_id FROM (SELECT DISTINCT gene_id FROM expr) ORDER BY {draw(42, 'genes', 'gene_id')}, gene_id LIMIT 40) " + _SIDE.format(name="SIM", part="< 5") + " UNION ALL " + _SIDE.format(name="REF", part=">= 5"))
def compare_expression(spark, sf):
    e = _expr(spark, sf)
    return compare.compare_expression(e.where("cluster < 5"), e.where("cluster >= 5")).select("gene", "dataset", *r6("mean_expr", "var_expr", "cv_expr", "zero_frac"))


_SPACE = """SELECT '{name}' AS dataset, round((SELECT avg(dist) FROM zn WHERE r <= 5 AND s = {s}), 6) AS nn_dist, round(avg(dist), 6) AS mean_dist, round(stddev_samp(dist), 6) AS sd_dist, round(stddev_samp(dist) / avg(dist), 6) AS cv FROM zp WHERE s = {s}"""


@query(""", z AS (SELECT cell_id, cluster >= 5 AS s, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM cells WINDOW w AS (PARTITION BY cluster >= 5)),
zp AS (SELECT a.s, a.cell_id, b.cell_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM z a JOIN z b ON a.s = b.s AND a.cell_id <> b.cell_id),
zn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, dst) AS r FROM zp) """ + _SPACE.format(name="simulated", s="false") + " UNION ALL " + _SPACE.format(name="reference", s="true"))
def compare_spatial(spark, sf):
    c = _cells(spark, sf)
    return compare.compare_spatial(c.where("cluster < 5"), c.where("cluster >= 5")).select("dataset", *r6("nn_dist", "mean_dist", "sd_dist", "cv"))


@query()
def negative_binomial_fit(spark, sf):
    return stats.fit_negative_binomial(_expr(spark, sf)).select("gene_id", F.round("size", 4).alias("size"), *r6("mu"))


@query("""SELECT CAST(i / 20.0 AS DOUBLE) AS at, round(avg(exp(-((value - i / 20.0) / 0.05) * ((value - i / 20.0) / 0.05) / 2)) / (0.05 * sqrt(2 * pi())), 6) AS density FROM pixels, range(0, 21) t(i) GROUP BY i""")
def kernel_density(spark, sf):
    return stats.kernel_density(_pixels(spark, sf), "value", [i / 20 for i in range(21)], 0.05).select("at", *r6("density"))


@query()
def intensity_kmeans(spark, sf):
    return simulate.intensity_clusters(simulate.threshold(_pixels(spark, sf)), 5).groupBy("intensity_cluster").agg(F.count("*").alias("n"))


@query()
def gaussian_field(spark, sf):
    return spatial.gaussian_field(_cells(spark, sf), 15.0).select("cell_id", *r6("field"))


@query()
def pca_scores(spark, sf):
    scores, _ = preprocess.pca(preprocess.log_normalize(_expr(spark, sf)), "value", 10)
    return scores.select("cell_id", F.transform("v", lambda x: F.round(F.abs(x), 4)).alias("v"))


@query()
def louvain_labels(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"))
    return preprocess.communities(e, 1.0)


@query()
def hdbscan_labels(spark, sf):
    return preprocess.density_clusters(_cells(spark, sf).select("cell_id", F.array("x", "y").alias("v")))


@query()
def umap_embedding(spark, sf):
    return preprocess.layout(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v")))


@query()
def simulate_counts(spark, sf):
    return simulate.simulate(_pixels(spark, sf).select("x", "y", "value"), Params())["expression"]


def _diagnostics(spark, sf, name):
    return compare.diagnostics(_cells(spark, sf), _expr(spark, sf))[name]


@query("SELECT * FROM cells")
def diagnostics_spatial(spark, sf):
    return _diagnostics(spark, sf, "spatial")


@query("SELECT cluster, gene_id, round(m, 6) AS mean_expr FROM means")
def diagnostics_profile(spark, sf):
    return _diagnostics(spark, sf, "profile").select("cluster", "gene_id", *r6("mean_expr"))


_MAPS = ", md AS (SELECT cell_id, avg(dist) AS m FROM pairs WHERE cluster = d GROUP BY cell_id) "


@query(_MAPS + "SELECT cell_id, round(m, 6) AS mean_dist, x, y, cluster FROM md JOIN cells USING (cell_id)")
def diagnostics_distance(spark, sf):
    return _diagnostics(spark, sf, "distance").select("cell_id", *r6("mean_dist"), "x", "y", "cluster")


@query(_MAPS + "SELECT cell_id, round(m, 6) AS mean_dist, round(5 + (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * (0.5 - 5), 6) AS dispersion FROM md")
def diagnostics_dispersion(spark, sf):
    return _diagnostics(spark, sf, "dispersion").select("cell_id", *r6("mean_dist", "dispersion"))


@query(_MAPS + "SELECT cell_id, round(m, 6) AS mean_dist, round(0.1 + (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * 0.4, 6) AS dropout FROM md")
def diagnostics_dropout(spark, sf):
    return _diagnostics(spark, sf, "dropout").select("cell_id", *r6("mean_dist", "dropout"))


@query(""", kept AS (SELECT * FROM expr WHERE gene_id NOT IN (SELECT gene_id FROM gstats WHERE v / (m * m) < (SELECT quantile_cont(v / (m * m), 0.1) FROM gstats)))
SELECT CAST(least(floor((count - lo) * 50.0 / (hi - lo)) + 1, 50) AS INT) AS bin, count(*) AS n FROM kept, (SELECT min(count) AS lo, max(count) AS hi FROM kept) GROUP BY bin""")
def diagnostics_histogram(spark, sf):
    return _diagnostics(spark, sf, "histogram")


@query("SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_count, CAST(sum(CAST(count > 0 AS INT)) AS BIGINT) AS n_feature, round(avg(CAST(count = 0 AS INT)), 6) AS zero_frac, any_value(c.x) AS x, any_value(c.y) AS y, any_value(c.cluster) AS cluster FROM expr JOIN cells c USING (cell_id) GROUP BY cell_id")
def diagnostics_observed_dropout(spark, sf):
    return _diagnostics(spark, sf, "observed_dropout").select("cell_id", "n_count", "n_feature", *r6("zero_frac"), "x", "y", "cluster")


@query(f""", capped AS (SELECT cell_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {draw(42, 'cap', 'cell_id')}, cell_id) AS r FROM cells) WHERE r <= 500),
best AS (SELECT gene_id FROM spec ORDER BY s DESC, gene_id LIMIT 20)
SELECT cell_id, gene_id, round((count - avg(count) OVER w) / nullif(stddev_samp(count) OVER w, 0), 6) AS z FROM expr WHERE cell_id IN (SELECT cell_id FROM capped) AND gene_id IN (SELECT gene_id FROM best) WINDOW w AS (PARTITION BY cell_id)""")
def diagnostics_heatmap(spark, sf):
    return _diagnostics(spark, sf, "heatmap").select("cell_id", "gene_id", *r6("z"))


@query(""", rep AS (SELECT DISTINCT coalesce(gene_id, 1) AS gene_id FROM (SELECT DISTINCT cluster FROM expr) c LEFT JOIN (SELECT cluster, arg_min(gene_id, (-s, gene_id)) AS gene_id FROM spec GROUP BY cluster) USING (cluster))
SELECT e.cell_id, e.cluster, e.gene_id, e.count, x, y FROM expr e JOIN cells USING (cell_id) WHERE e.gene_id IN (SELECT gene_id FROM rep)""")
def diagnostics_representative(spark, sf):
    return _diagnostics(spark, sf, "representative").select("cell_id", "cluster", "gene_id", "count", "x", "y")


@query("SELECT cell_id, CAST(sum(CAST(cell_id <> dst AND dist <= 10 AS INT)) AS BIGINT) AS n, any_value(c.x) AS x, any_value(c.y) AS y, any_value(c.cluster) AS cluster FROM pairs p JOIN cells c USING (cell_id) GROUP BY cell_id")
def diagnostics_density(spark, sf):
    return _diagnostics(spark, sf, "density").select("cell_id", "n", "x", "y", "cluster")


def _sides(spark, sf):
    c, e = _cells(spark, sf), _expr(spark, sf)
    return tuple({"cells": c.where(part), "expression": e.where(part).drop("cluster")} for part in ("cluster < 5", "cluster >= 5"))


@query()
def validation_summary(spark, sf):
    return compare.validation_summary(*_sides(spark, sf)).select("test", *r6("value"))


@query()
def compare_clustering(spark, sf):
    return compare.compare_clustering(*_sides(spark, sf))[1].select("dataset", "cluster", *r6("prop_size"))


_MATRIX = """, lay AS (SELECT cell_id, cluster < 5 AS s, gene_id, ln(1 + coalesce(count * 10000.0 / nullif(sum(count) OVER (PARTITION BY cell_id), 0), 0)) AS value FROM expr),
mat AS (SELECT a.s, a.gene_id AS g1, b.gene_id AS g2, corr(a.value, b.value) AS r FROM lay a JOIN lay b ON a.cell_id = b.cell_id WHERE a.gene_id IN (SELECT gene_id FROM tops) AND b.gene_id IN (SELECT gene_id FROM tops) GROUP BY ALL)
"""
_TOPS = ", " + ", ".join(f"""g{k} AS (SELECT gene_id, log10(avg(count)) AS m, log10(var_samp(count)) AS v FROM expr WHERE cluster {part} GROUP BY gene_id HAVING avg(count) > 0 AND var_samp(count) > 0),
t{k} AS (SELECT gene_id FROM g{k}, (SELECT regr_slope(v, m) AS a, regr_intercept(v, m) AS b FROM g{k}) ORDER BY v - a * m - b DESC, gene_id LIMIT 50)""" for k, part in ((1, "< 5"), (2, ">= 5"))) + ", tops AS (SELECT gene_id FROM t1 SEMI JOIN t2 USING (gene_id))"


@query(_TOPS + _MATRIX + "SELECT CASE WHEN s THEN 'SIM' ELSE 'REF' END AS \"Dataset\", g1 AS \"Gene1\", g2 AS \"Gene2\", round(CASE WHEN g1 = g2 THEN 1 ELSE r END, 6) AS \"Corr\" FROM mat")
def gene_correlation_matrices(spark, sf):
    a, b = _sides(spark, sf)
    return compare.reduced_validation(a["expression"], b["expression"])[1].select("Dataset", "Gene1", "Gene2", *r6("Corr"))


@query(_TOPS + _MATRIX + """SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS ra, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rb
FROM (SELECT a.r, b.r AS q FROM mat a JOIN mat b ON a.g1 = b.g1 AND a.g2 = b.g2 AND a.s AND NOT b.s WHERE a.g1 < a.g2))""")
def correlation_matrix_similarity(spark, sf):
    a, b = _sides(spark, sf)
    return compare.reduced_validation(a["expression"], b["expression"])[2].select(*r6("rho"))


@query(_SIL + "SELECT round(avg(w), 6) AS mean_silhouette FROM sil")
def mean_silhouette(spark, sf):
    return spatial.silhouette(_cells(spark, sf)).agg(F.round(F.avg("silhouette"), 6).alias("mean_silhouette"))
