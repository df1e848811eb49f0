"""Clustering queries (M1-M13, J9, J10, W9, W14) on the embeddings table and on
the district feature matrix derived from the loads."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cluster import dbscan as DB
from ..operators.cluster import metrics as MT
from ..operators.cluster.features import feature_long, feature_matrix, multistream_matrix
from ..operators.cluster.metric_index import knn_distances, radius_edges
from ..operators.cluster.pairs import distance_summary
from ..session import pinned
from ..sources.tables import table
from .base import CLEAN_CTE, DCUBE_CTE, SCUBE_ONLY, district_cube, section_cube, sql
from .q_agg import MLONG_SQL
from .registry import query

G = "District_Code"


def emb(spark, sf, noise=False):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    if noise:
        e = e.withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return e


PTS = "pts AS (SELECT vec_id AS id, label AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PTS_NOISE = "pts AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN -1 ELSE label END AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PAIRS = "pd AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.k AS ki, b.k AS kj, list_distance(a.v, b.v) AS d FROM pts a, pts b)"
KNN = ("knn AS MATERIALIZED (SELECT i, d AS kdist FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM pd) WHERE rn = 5)")
KNEE = """ks AS (SELECT kdist, row_number() OVER (ORDER BY kdist) - 1 AS idx FROM knn),
dd AS (SELECT a.idx, c.kdist - 2 * b.kdist + a.kdist AS d2 FROM ks a JOIN ks b ON b.idx = a.idx + 1 JOIN ks c ON c.idx = a.idx + 2),
knee AS (SELECT arg_min(idx, [-d2, idx]) + 1 AS knee_idx FROM dd),
eps AS (SELECT k.knee_idx, s.kdist AS eps, (SELECT count(*) FROM ks) AS n FROM knee k JOIN ks s ON s.idx = k.knee_idx)"""


@query("m1_feature_matrix", sql(DCUBE_CTE, MLONG_SQL.replace("{v}", "tons_total"), select=
    "SELECT District_Code, week_start, round(z, 6) + 0.0 AS z FROM flong"))
def m1(spark, sf):
    f = feature_long(district_cube(spark, sf), G, "tons_total")
    return f.select(G, "week_start", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query("m2_multistream_features")
def m2(spark, sf):
    m = multistream_matrix(district_cube(spark, sf), G)
    return m.select(G, F.size("features").alias("n_features"),
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sum_sq"))


@query("m3_pca_95")
def m3(spark, sf):
    from ..operators.cluster.kmeans import pca_95
    f = feature_matrix(district_cube(spark, sf), G, "tons_total")
    out, k, model = pca_95(f, "features")
    cum = float(sum(model.explainedVariance.toArray()[:k])) if model is not None else 0.0
    return out.select(G, F.size("pca").alias("n_components"), F.lit(cum).alias("explained_variance"))


@query("m4_kmeans_best_of_n")
def m4(spark, sf):
    from ..operators.cluster.kmeans import kmeans_best_of
    lab, cost, _ = kmeans_best_of(emb(spark, sf), "v", 10, n_init=10, seed=42)
    return lab.select("vec_id", "cluster", F.lit(cost).alias("inertia"))


@query("m5_silhouette_by_k")
def m5(spark, sf):
    from ..operators.cluster.kmeans import pca_95, silhouette_by_k
    from ..operators.cluster.level import K_RANGE, keyed
    X = keyed(feature_matrix(district_cube(spark, sf), G, "tons_total"), G)
    pca, _, _ = pca_95(X, "features")
    return silhouette_by_k(pca.select("gid", "pca"), "gid", "pca", K_RANGE)


@query("m6_dtw_kmeans")
def m6(spark, sf):
    from ..operators.cluster.level import K_RANGE, capped, dtw_search, keyed
    X = keyed(feature_matrix(district_cube(spark, sf), G, "tons_total"), G)
    a, _, _ = dtw_search(X, "gid", "features", capped(K_RANGE, X.count()))
    return X.select(G, "gid").join(a, "gid").select(G, "cluster", "dist")


@query("m7_ward_linkage")
def m7(spark, sf):
    from ..operators.cluster.ward import ward_linkage
    lk, _ = ward_linkage(feature_matrix(district_cube(spark, sf), G, "tons_total"), G, "features")
    return lk.select("step", "left", "right", F.round("height", 9).alias("height"), "size")


@query("m8_tree_cut_maxclust")
def m8(spark, sf):
    from ..operators.cluster.level import K_RANGE, capped, keyed, ward_search
    X = keyed(feature_matrix(district_cube(spark, sf), G, "tons_total"), G)
    cut, _, _ = ward_search(X, "gid", "features", capped(K_RANGE, X.count()))
    return X.select(G, "gid").join(cut, "gid").select(G, "cluster")


CENT = """el AS (SELECT id, k, unnest(v) AS x, unnest(range(len(v))) AS i FROM pts WHERE k <> -1),
cent AS (SELECT k, i, avg(x) AS mu FROM el GROUP BY k, i),
gm AS (SELECT i, avg(x) AS g FROM el GROUP BY i),
nk AS (SELECT k, count(*) AS n_c FROM pts WHERE k <> -1 GROUP BY k),
pdist AS (SELECT el.id, el.k, sqrt(sum((x - mu) * (x - mu))) AS dc, sum((x - mu) * (x - mu)) AS sq FROM el JOIN cent USING (k, i) GROUP BY 1, 2),
sk AS (SELECT k, avg(dc) AS S FROM pdist GROUP BY k),
cdist AS (SELECT a.k AS ka, b.k AS kb, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS d FROM cent a JOIN cent b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2),
dbv AS (SELECT avg(r) AS db FROM (SELECT ka, max((s1.S + s2.S) / d) AS r FROM cdist JOIN sk s1 ON s1.k = ka JOIN sk s2 ON s2.k = kb GROUP BY ka)),
chv AS (SELECT ((SELECT sum(n_c * bs) FROM (SELECT k, sum((mu - g) * (mu - g)) AS bs FROM cent JOIN gm USING (i) GROUP BY k) JOIN nk USING (k)) / ((SELECT count(*) FROM nk) - 1))
  / ((SELECT sum(sq) FROM pdist) / ((SELECT count(*) FROM pts WHERE k <> -1) - (SELECT count(*) FROM nk))) AS ch),
silv AS (SELECT avg(CASE WHEN single THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM
  (SELECT i, CASE WHEN n > 1 THEN sd / (n - 1) ELSE 0 END AS a, n = 1 AS single FROM
     (SELECT i, sum(d) AS sd, count(*) AS n FROM pd WHERE ki = kj AND ki <> -1 GROUP BY i)) o
  JOIN (SELECT i, min(sd / n) AS b FROM (SELECT i, kj, sum(d) AS sd, count(*) AS n FROM pd WHERE ki <> kj AND ki <> -1 AND kj <> -1 GROUP BY i, kj) GROUP BY i) t USING (i))"""


@query("m9_cluster_metrics", sql(PTS_NOISE, PAIRS, CENT, select=
    "SELECT round((SELECT sil FROM silv), 6) AS silhouette, round((SELECT ch FROM chv), 4) AS calinski_harabasz, "
    "round((SELECT db FROM dbv), 6) AS davies_bouldin, CAST((SELECT count(*) FROM nk) AS INTEGER) AS n_clusters"))
def m9(spark, sf):
    m = MT.cluster_metrics(emb(spark, sf, noise=True), "vec_id", "v", "label")
    return m.select(F.round("silhouette", 6).alias("silhouette"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"),
                    F.round("davies_bouldin", 6).alias("davies_bouldin"), "n_clusters")


@query("j9_pairwise_distance_summary", sql(PTS, PAIRS, select=
    "SELECT i AS vec_id, round(min(d) FILTER (WHERE i <> j), 6) AS nearest, round(avg(d) FILTER (WHERE i <> j), 6) AS mean_dist, "
    "round(max(d) FILTER (WHERE i <> j), 6) AS farthest FROM pd GROUP BY i"))
def j9(spark, sf):
    s = distance_summary(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return s.select("vec_id", *[F.round(c, 6).alias(c) for c in ("nearest", "mean_dist", "farthest")])


@query("w14_knn_distance", sql(PTS, PAIRS, KNN, select="SELECT i AS vec_id, round(kdist, 6) AS kdist FROM knn"))
def w14(spark, sf):
    k = knn_distances(emb(spark, sf), "vec_id", "v", 5)
    return k.select("vec_id", F.round("kdist", 6).alias("kdist"))


@query("m10_auto_eps", sql(PTS, PAIRS, KNN, KNEE, select="SELECT knee_idx, round(eps, 6) AS eps, n FROM eps"))
def m10(spark, sf):
    e = DB.auto_eps(emb(spark, sf), "vec_id", "v", 5)
    return e.select(F.col("knee_idx").cast("bigint").alias("knee_idx"), F.round("eps", 6).alias("eps"), F.col("n").cast("bigint").alias("n"))


@query("w9_knee_second_difference", sql(CLEAN_CTE, SCUBE_ONLY, select="""SELECT knee_idx, round(v, 6) AS value, n FROM (
  WITH s AS (SELECT avg(tons_total) AS v FROM scube GROUP BY Section_Code),
  ks AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM s),
  dd AS (SELECT a.idx, c.v - 2 * b.v + a.v AS d2 FROM ks a JOIN ks b ON b.idx = a.idx + 1 JOIN ks c ON c.idx = a.idx + 2)
  SELECT (SELECT arg_min(idx, [-d2, idx]) + 1 FROM dd) AS knee_idx, (SELECT count(*) FROM ks) AS n,
         (SELECT v FROM ks WHERE idx = (SELECT arg_min(idx, [-d2, idx]) + 1 FROM dd)) AS v)"""))
def w9(spark, sf):
    s = section_cube(spark, sf).groupBy("Section_Code").agg(F.avg("tons_total").alias("v"))
    k = DB.knee(s, "v")
    return k.select(F.col("knee_idx").cast("bigint").alias("knee_idx"), F.round("eps", 6).alias("value"), F.col("n").cast("bigint").alias("n"))


@query("j10_radius_join", sql(PTS, PAIRS, KNN, KNEE, select=
    "SELECT i, j, round(d, 6) AS d FROM pd WHERE d <= (SELECT eps FROM eps)"))
def j10(spark, sf):
    e = emb(spark, sf)
    eps = DB.auto_eps(e, "vec_id", "v", 5).first()["eps"]
    r = radius_edges(e, "vec_id", "v", eps)
    return r.select("i", "j", F.round("d", 6).alias("d"))


DBSCAN_SQL = """deg AS (SELECT i, count(*) AS c FROM pd WHERE d <= (SELECT eps FROM eps) GROUP BY i),
core AS (SELECT i AS u FROM deg WHERE c >= 3),
ce AS (SELECT i, j FROM pd WHERE d <= (SELECT eps FROM eps) AND i IN (SELECT u FROM core) AND j IN (SELECT u FROM core)),
reach AS (SELECT i AS u, min(j) AS lab FROM (
  WITH RECURSIVE r(i, j) AS (SELECT u, u FROM core UNION SELECT r.i, ce.j FROM r JOIN ce ON ce.i = r.j) SELECT * FROM r) GROUP BY i),
num AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cl FROM (SELECT DISTINCT lab FROM reach)),
corelab AS (SELECT u, cl FROM reach JOIN num USING (lab)),
bl AS (SELECT p.i AS u, min(c.cl) AS bc FROM pd p JOIN corelab c ON c.u = p.j WHERE p.d <= (SELECT eps FROM eps) GROUP BY p.i)"""


@query("m11_dbscan", sql(PTS, PAIRS, KNN, KNEE, DBSCAN_SQL, select=
    "SELECT p.id AS vec_id, CAST(coalesce(c.cl, b.bc, -1) AS INTEGER) AS cluster FROM pts p "
    "LEFT JOIN corelab c ON c.u = p.id LEFT JOIN bl b ON b.u = p.id"))
def m11(spark, sf):
    e = emb(spark, sf)
    eps = DB.auto_eps(e, "vec_id", "v", 5).first()["eps"]
    return DB.dbscan(e, "vec_id", "v", eps, 3)


def _ari_sql(a, b):
    return f"""(SELECT CASE WHEN mx - ex = 0 THEN 1.0 ELSE (sij - ex) / (mx - ex) END FROM (
  SELECT sij, (sa * sb) / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM (
    SELECT (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM lab WHERE {a} <> -1 AND {b} <> -1 GROUP BY {a}, {b})) AS sij,
           (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM lab WHERE {a} <> -1 AND {b} <> -1 GROUP BY {a})) AS sa,
           (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM lab WHERE {a} <> -1 AND {b} <> -1 GROUP BY {b})) AS sb,
           (SELECT count(*) FROM lab WHERE {a} <> -1 AND {b} <> -1) AS n)))"""


METHODS = ["cluster_label", "cluster_mod10", "cluster_noisy"]
LAB_SQL = ("lab AS (SELECT vec_id, label AS cluster_label, CAST(vec_id % 10 AS INTEGER) AS cluster_mod10, "
           "CASE WHEN label % 3 = 0 THEN -1 ELSE label END AS cluster_noisy FROM embeddings)")


@query("m13_adjusted_rand_matrix", sql(LAB_SQL, select=" UNION ALL ".join(
    f"SELECT '{a}' AS method_a, '{b}' AS method_b, round({_ari_sql(a, b)}, 9) AS ari"
    for i, a in enumerate(METHODS) for b in METHODS[i + 1:])))
def m13(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("cluster_label"), (F.col("vec_id") % 10).cast("int").alias("cluster_mod10"),
        F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label")).alias("cluster_noisy")).checkpoint(eager=True)
    out = None
    for i, a in enumerate(METHODS):
        for b in METHODS[i + 1:]:
            r = MT.adjusted_rand(e, a, b).select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.round("ari", 9).alias("ari"))
            out = r if out is None else out.unionByName(r)
    return out


LEVELS = ((district_cube, G, "district"), (section_cube, "Section_Code", "section"))


def _levels(spark, sf, part: int):
    """One of the tables (assignments, metrics, curves) of both levels; assignments are tagged with their level."""
    from ..operators.cluster.level import cluster_level, side_by_side

    def one(cube_of, group, level):
        cube = pinned(cube_of(spark, sf).select(group, "week_start", "tons_refuse", "tons_total"), "level-cube")
        got = cluster_level(cube, group, level, value="tons_total", parts=[("assignments", "metrics", "curves")[part]])[part]
        return got.withColumnRenamed(group, "group_id").withColumn("level", F.lit(level)) if part == 0 else got
    first, second = side_by_side(spark, [lambda args=args: one(*args) for args in LEVELS])
    return first.unionByName(second)


@query("m12_cluster_level")
def m12(spark, sf):
    """Metrics of all methods at both levels."""
    return _levels(spark, sf, 1)


@query("m12_cluster_assignments")
def m12a(spark, sf):
    """Clusters of every district and section under all methods."""
    return _levels(spark, sf, 0)


@query("m12_silhouette_curves")
def m12c(spark, sf):
    """Silhouette by k of the searched methods, tagged with method and level."""
    return _levels(spark, sf, 2)
