"""Clustering operators against brute force on small fixtures."""
import numpy as np
import pytest

from haulcube.operators.cluster.dbscan import dbscan
from haulcube.operators.cluster.dtw import DtwSearch, dtw, dtw_costs, nearest_centres
from haulcube.operators.cluster.metrics import adjusted_rand, cluster_metrics, silhouette, silhouettes
from haulcube.operators.cluster import metric_index as MI
from haulcube.operators.cluster.metric_index import knn_distances, radius_edges
from haulcube.operators.cluster.ward import cut_tree, cut_tree_all, ward_linkage
from haulcube.operators.components import components


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 0.3, (15, 3)), rng.normal(3, 0.3, (15, 3)), rng.normal((0, 4, 0), 0.3, (10, 3))])
    df = spark.createDataFrame([(i, X[i].tolist(), int(i >= 15) + int(i >= 30)) for i in range(len(X))],
                               "id long, v array<double>, lab long")
    return X, df


def _d(X):
    return np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))


def test_silhouette_brute(pts):
    X, df = pts
    lab = np.array([int(i >= 15) + int(i >= 30) for i in range(len(X))])
    D = _d(X)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    got = silhouette(df, "id", "v", "lab").first()[0]
    assert abs(got - np.mean(s)) < 1e-9


def test_knn_brute(pts):
    X, df = pts
    want = np.sort(_d(X), axis=1)[:, 4]
    got = {r["id"]: r["kdist"] for r in knn_distances(df, "id", "v", 5).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(len(X)))


def test_ward_heights_and_cut(pts):
    X, df = pts
    lk, leaves = ward_linkage(df, "id", "v")
    tiled, _ = ward_linkage(df, "id", "v", block_rows=16)
    assert [r[:3] + r[4:] for r in sorted(lk.collect())] == [r[:3] + r[4:] for r in sorted(tiled.collect())]
    heights = sorted(r["height"] for r in lk.collect())
    cl = {i: (1, X[i]) for i in range(len(X))}
    hs, nid = [], 1000
    while len(cl) > 1:
        best = min(((np.sqrt(2 * cl[a][0] * cl[b][0] / (cl[a][0] + cl[b][0])) * np.linalg.norm(cl[a][1] - cl[b][1]), a, b)
                    for a in cl for b in cl if a < b))
        d, a, b = best
        (na, ca), (nb, cb) = cl.pop(a), cl.pop(b)
        cl[nid] = (na + nb, (na * ca + nb * cb) / (na + nb))
        nid += 1
        hs.append(d)
    assert np.allclose(heights, sorted(hs))
    cuts = cut_tree_all(lk, leaves, "id", [2, 3, 5]).collect()
    for k in (2, 3, 5):
        one = {r["id"]: r["cluster"] for r in cut_tree(lk, leaves, "id", k).collect()}
        assert one == {r["id"]: r["cluster"] for r in cuts if r["k"] == k} and set(one.values()) == set(range(1, k + 1))
    lab = {r["id"]: r["cluster"] for r in cut_tree(lk, leaves, "id", 3).collect()}
    assert len(set(lab.values())) == 3
    assert len({lab[i] for i in range(15)}) == 1 and len({lab[i] for i in range(30, 40)}) == 1


def test_dbscan_brute(pts):
    X, df = pts
    eps = 0.6
    D = _d(X)
    nb = D <= eps
    core = nb.sum(1) >= 3
    lab = -np.ones(len(X), int)
    c = 0
    for i in range(len(X)):
        if core[i] and lab[i] == -1:
            stack, lab[i] = [i], c
            while stack:
                p = stack.pop()
                if core[p]:
                    for q in np.nonzero(nb[p])[0]:
                        if lab[q] == -1:
                            lab[q] = c
                            stack.append(q)
            c += 1
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", "v", eps, 3).collect()}
    assert [got[i] for i in range(len(X))] == lab.tolist()


def test_ari_identity_and_relabel(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3 + 1) * 10) for i in range(30)], "id long, a long, b long")
    assert abs(adjusted_rand(df, "a", "b").first()[0] - 1.0) < 1e-12


def test_dtw_brute():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=20), rng.normal(size=17)
    D = np.full((21, 18), np.inf)
    D[0, 0] = 0
    for i in range(1, 21):
        for j in range(1, 18):
            D[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(D[i - 1, j - 1], D[i - 1, j], D[i, j - 1])
    d, path = dtw(x, y)
    assert abs(d - np.sqrt(D[20, 17])) < 1e-12 and path[0] == (0, 0) and path[-1] == (19, 16)


def test_ward_ties_and_tiny_inputs(spark):
    """A grid is all ties: one rule at every tile size."""
    df = spark.createDataFrame([(10 * i + j, [float(i), float(j)]) for i in range(5) for j in range(5)], "id long, v array<double>")
    trees = [sorted(tuple(r) for r in ward_linkage(df, "id", "v", block_rows=b)[0].collect()) for b in (9, 2048)]
    assert trees[0] == trees[1] and len(trees[0]) == 24
    assert ward_linkage(df.limit(1), "id", "v")[0].count() == 0 and ward_linkage(df.limit(0), "id", "v")[0].count() == 0
    chain = spark.createDataFrame([(i, [5.0 ** i]) for i in range(8)], "id long, v array<double>")     # one merge a round
    assert [r["size"] for r in sorted(ward_linkage(chain, "id", "v")[0].collect())] == list(range(2, 9))


def test_many_labelings_in_one_pass(pts):
    X, df = pts
    d = df.selectExpr("id", "v", "lab", "array(lab, id % 4, if(id % 5 = 0, -1, lab), 0) AS labs", "id % 4 AS m", "if(id % 5 = 0, -1, lab) AS noisy")
    got = {r["labeling"]: r["silhouette"] for r in silhouettes(d, "id", "v", "labs").collect()}
    want = [silhouette(d, "id", "v", c).first()[0] for c in ("lab", "m", "noisy")]
    assert set(got) == {0, 1, 2} and all(abs(got[i] - w) < 1e-12 for i, w in enumerate(want))


def test_silhouettes_over_blocks(spark, monkeypatch):
    """A point is copied once a block; copies far from the origin have distance zero, not what a product leaves."""
    from haulcube.operators.cluster import pairs as P
    assert -(-600_000 // P.block_size(600_000, 64)) <= 20 and P.block_size(10**9, 64) * 64 <= P.BLOCK_VALUES
    monkeypatch.setattr(P, "LEAST_ROWS", 16)
    rng = np.random.default_rng(13)
    X = np.concatenate([1e4 + rng.normal(size=(60, 3)), np.tile([[1e4, 1e4, 1e4 + 9]], (20, 1)), np.tile([[1e4 + 7, 1e4, 1e4]], (20, 1))])
    lab = np.repeat([0, 1, 2, 3], [30, 30, 20, 20])
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(X, lab))], "id long, v array<double>, lab long")
    D = _d(X)
    a = np.array([D[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1) for i in range(100)])
    b = np.array([min(D[i, lab == k].mean() for k in range(4) if k != lab[i]) for i in range(100)])
    assert abs(silhouette(df, "id", "v", "lab").first()[0] - ((b - a) / np.maximum(a, b)).mean()) < 1e-9


def test_distance_summary_meets_all_points_once_a_block(spark, monkeypatch):
    """J9 over several blocks and shuffle partitions: no pair is lost, rows of one id are no others, a point is sent once a block."""
    from haulcube.operators.cluster import pairs as P
    sent, real = [], P.block_pairs
    monkeypatch.setattr(P, "block_pairs", lambda points, pairs, *args: sent.append((points, pairs)) or real(points, pairs, *args))
    rng = np.random.default_rng(14)
    X = np.concatenate([rng.normal(size=(2500, 3)), 1e3 + rng.normal(size=(300, 3)), np.tile([[4.0, 4.0, 4.0]], (50, 1))]).astype(np.float32)
    ids = np.arange(len(X)) % 2700                          # ids from 0 to 149 come twice, mostly far apart
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, X)], "id long, v array<float>")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: r[1:] for r in P.distance_summary(df, "id", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    D, others = _d(X.astype(np.float64)), ids[:, None] != ids[None, :]
    assert got.keys() == set(ids.tolist())
    for k in range(2700):
        d = D[ids == k][others[ids == k]]
        assert np.allclose(got[k], (d.min(), d.mean(), d.max()), rtol=1e-12, atol=1e-12)
    (points, pairs), = sent
    blocks = {b for pair in pairs for b in pair}
    assert points.schema["v"].dataType.simpleString() == "array<float>" and 3 <= len(blocks) <= P.BLOCKS
    assert sorted(pairs) == [(a, b) for a in sorted(blocks) for b in sorted(blocks) if a <= b]
    assert {r["block"]: r["count"] for r in points.groupBy("block").count().collect()}.keys() == blocks


def test_distance_tiles_equal_differences():
    """Far from the origin, tight, overflowing and non-finite values: as by differences, over several tiles."""
    from haulcube.operators.cluster import pairs as P
    rng = np.random.default_rng(15)
    X, Y = rng.normal(size=(300, 8)), rng.normal(size=(1100, 8))
    wild = Y.copy()
    wild[3, 1], wild[1050, 2], wild[7, 0] = np.inf, -np.inf, np.nan
    for A, B in ((X, Y), (X + 1e6, Y + 1e6), (X, X), (1e-4 * X + 5, 1e-4 * Y + 5), (1e200 * X, 1e200 * Y), (wild[:300], wild), (X, np.vstack([Y, 1e9 + Y[:1]])), (X[:0], Y)):
        with np.errstate(all="ignore"):
            want = np.sqrt(((A[:, None] - B[None]) ** 2).sum(-1))
            got = np.full(want.shape, -1.0)
            for s, t, D in P.distance_tiles(A, B):
                got[s:s + len(D), t:t + D.shape[1]] = D
        assert np.allclose(got, want, rtol=1e-12, atol=0, equal_nan=True)


def test_davies_bouldin_brute(pts):
    X, df = pts
    lab = np.array([int(i >= 15) + int(i >= 30) for i in range(len(X))])
    mu = np.array([X[lab == k].mean(0) for k in range(3)])
    S = np.array([np.linalg.norm(X[lab == k] - mu[k], axis=1).mean() for k in range(3)])
    want = np.mean([max((S[a] + S[b]) / np.linalg.norm(mu[a] - mu[b]) for b in range(3) if b != a) for a in range(3)])
    assert abs(cluster_metrics(df, "id", "v", "lab").first()["davies_bouldin"] - want) < 1e-9


def test_index_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(c, 0.2, (30, 3)) for c in rng.uniform(-5, 5, (4, 3))] + [np.tile([[1.0, 2.0, 3.0]], (25, 1)), [[90.0, 0, 0]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for args in ({}, {"per_pivot": 25, "block_rows": 16}):
        for eps in (0.0, 0.4):
            got = {(r.i, r.j): r.d for r in radius_edges(df, "id", "v", eps, **args).collect()}
            assert got.keys() == set(zip(*(a.tolist() for a in np.nonzero(D <= eps))))
            assert all(abs(d - D[i, j]) < 1e-12 for (i, j), d in got.items())
        for k in (5, 40):
            want = np.sort(D, axis=1)[:, k - 1]
            got = {r["id"]: r["kdist"] for r in knn_distances(df, "id", "v", k, **args).collect()}
            assert len(got) == len(X) and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert knn_distances(df.limit(3), "id", "v", 5).count() == 3 and radius_edges(df.limit(0), "id", "v", 1).count() == 0


def test_index_pairs_a_tenth_of_clustered_points(spark):
    rng = np.random.default_rng(9)
    X = np.concatenate([rng.normal(c, 0.1, (1000, 4)) for c in rng.uniform(-10, 10, (20, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    index = MI.build_index(df, "id", "v")
    for visiting in (MI.visits(index, radius=0.05), MI.visits(index, MI._bounds(index, 5))):
        sizes = dict(enumerate(index.sizes.tolist()))
        pairs = sum(r["count"] * sizes[r["q"]] for r in visiting.groupBy("q").count().collect())
        assert pairs < len(X) ** 2 / 10


def test_points_are_copied_once_a_block_where_no_partition_is_out_of_reach(spark):
    """Wide noise: every ball reaches every pivot, but a point goes to blocks, not to pivots."""
    rng = np.random.default_rng(10)
    X = np.concatenate([rng.normal(size=(2500, 16)), np.tile(rng.normal(size=(1, 16)), (60, 1)), 1e3 + rng.normal(size=(40, 16))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    index = MI.build_index(df, "id", "v", per_pivot=40)
    bounds = MI._bounds(index, 5)
    meeting = MI.Meeting(index, bounds)
    blocks = len({b for pair in meeting.pairs for b in pair})
    assert len(index.pivots) == 65 and MI.visits(index, bounds).count() > 30 * len(X) and blocks <= 4
    D = _d(X)
    got = {r["id"]: r["kdist"] for r in knn_distances(df, "id", "v", 5, per_pivot=40).collect()}
    want = np.sort(D, axis=1)[:, 4]
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(len(X)))
    eps = float(np.median(want))
    edges = {(r.i, r.j) for r in radius_edges(df, "id", "v", eps, per_pivot=40).collect()}
    assert edges == set(zip(*(a.tolist() for a in np.nonzero(D <= eps))))


def test_dbscan_over_several_blocks(spark, monkeypatch):
    from haulcube.operators.cluster import pairs as P
    monkeypatch.setattr(P, "LEAST_ROWS", 20)
    rng = np.random.default_rng(12)
    X = np.concatenate([rng.normal(c, 0.6, (40, 2)) for c in ((0, 0), (4, 0), (0, 5))] + [rng.uniform(-3, 8, (40, 2))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    near = _d(X) <= 0.5
    core = np.flatnonzero(near.sum(1) >= 4)
    lab, n = {}, 0
    for c in core.tolist():
        if c not in lab:
            stack = [c]
            while stack:
                x = stack.pop()
                if x not in lab:
                    lab[x] = n
                    stack += [int(y) for y in np.flatnonzero(near[x]) if y in core]
            n += 1
    want = {i: lab[i] if i in lab else min((lab[j] for j in np.flatnonzero(near[i]).tolist() if j in lab), default=-1) for i in range(len(X))}
    assert {r["id"]: r["cluster"] for r in dbscan(df, "id", "v", 0.5, 4).collect()} == want


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(4)
    order = rng.permutation(10_000).tolist()
    links = list(zip(order, order[1:])) + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (30_000, 30_000)]
    edges = spark.createDataFrame(links, "i long, j long")
    nodes = edges.selectExpr("explode(array(i, j)) AS node")
    got, rounds = components(nodes, edges)
    assert rounds < 20 and {(r[0], r[1]) for r in got.groupBy("component").count().collect()} == {(0, 10_000), (20_000, 3), (30_000, 1)}


def plain_cost(x, y):
    D = np.full((len(x) + 1, len(y) + 1), np.inf)
    D[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            D[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(D[i, j], D[i, j + 1], D[i + 1, j])
    return D


def test_pruned_centres_equal_plain(spark):
    rng = np.random.default_rng(2)
    X, C = np.cumsum(rng.normal(size=(12, 70)), 1), np.cumsum(rng.normal(size=(9, 70)), 1)
    plain = np.array([[plain_cost(x, c)[-1, -1] for c in C] for x in X])
    cost, best = nearest_centres(X, C, [(0, 2), (2, 5), (5, 9)])
    for g, (a, b) in enumerate([(0, 2), (2, 5), (5, 9)]):
        assert (best[:, g] == a + plain[:, a:b].argmin(1)).all() and np.allclose(cost[:, g], plain[:, a:b].min(1), rtol=1e-12)
    rows, cols = np.repeat(np.arange(12), 9), np.tile(np.arange(9), 12)
    some = dtw_costs(X[rows], C[cols], np.full(108, np.median(plain)))
    assert np.allclose(some[some < np.inf], plain[rows, cols][some < np.inf]) and (plain[rows, cols][np.isinf(some)] > np.median(plain)).all()


def test_dtw_search_equals_plain_kmeans(spark):
    rng = np.random.default_rng(6)
    X = np.concatenate([np.sin(np.linspace(0, 6, 24) + p)[None] + rng.normal(0, 0.2, (6, 24)) for p in (0, 1.5, 3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    search = DtwSearch(df, "id", "v", [2, 3, 4]).advance(4)
    got = {(r.id, r.k): r.cluster for r in search.assign().collect()}
    from pyspark.sql import functions as F
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").collect()]
    for k in (2, 3, 4):
        centres = X[order[:k]].copy()
        for _ in range(search.rounds[k]):
            s, n = np.zeros_like(centres), np.zeros_like(centres)
            for x in X:
                c = int(np.argmin([plain_cost(x, y)[-1, -1] for y in centres]))
                D = plain_cost(x, centres[c])
                i = j = len(x)
                while i:
                    s[c, j - 1] += x[i - 1]
                    n[c, j - 1] += 1
                    _, i, j = min([(D[i - 1, j - 1], i - 1, j - 1), (D[i - 1, j], i - 1, j), (D[i, j - 1], i, j - 1)], key=lambda t: t[0])
            centres = np.where(n > 0, s / np.maximum(n, 1), centres)
        assert np.allclose(search.centres[k], centres)
        assert all(got[i, k] == int(np.argmin([plain_cost(x, y)[-1, -1] for y in centres])) for i, x in enumerate(X))


def test_methods_of_a_level_run_side_by_side(spark):
    import threading
    from haulcube.operators.cluster.level import side_by_side
    gate = threading.Barrier(3, timeout=60)                 # passed only when all three are under way
    assert side_by_side(spark, [lambda i=i: gate.wait() * 0 + spark.range(i).count() for i in range(3)]) == [0, 1, 2]
