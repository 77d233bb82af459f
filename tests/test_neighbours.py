"""Neighbours, density clusters and oversampling against brute force."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import shared_folder
from plumbline.operators import cluster, cluster_metrics, neighbours, resample


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate(
        [rng.normal(c, 0.3, (90, 2)) for c in [(0, 0), (3, 3), (0, 4)]]
        + [rng.uniform(-3, 7, (30, 2)), np.zeros((150, 2))]
    )
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    return spark.createDataFrame(rows, "id long, a double, b double"), pts


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)


def gaps(pts):
    return np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))


def test_kth_neighbour_counts_copies_and_the_row_itself(cloud):
    df, pts = cloud
    got = {r["id"]: r["distance"] for r in neighbours.neighbour_distance(df, ["a", "b"], 5, ["id"]).collect()}
    want = np.sort(gaps(pts), axis=1)[:, 4]
    assert len(got) == len(pts)
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-12
    assert neighbours.density_radius(df, ["a", "b"]) == pytest.approx(np.percentile(want, 90))


@pytest.mark.parametrize("least", [3, 10])
def test_density_clusters(cloud, least):
    df, pts = cloud
    eps, d, n = 0.3, gaps(pts), len(pts)
    hit = d <= eps
    core = hit.sum(1) >= least
    want, count = np.full(n, -1), 0
    for i in range(n):
        if core[i] and want[i] < 0:
            stack, want[i] = [i], count
            while stack:
                for v in np.nonzero(hit[stack.pop()] & core)[0]:
                    if want[v] < 0:
                        want[v] = count
                        stack.append(v)
            count += 1
    for i in np.nonzero(~core)[0]:
        j = np.where(core, d[i], np.inf).argmin()
        if core[j] and d[i, j] <= eps:
            want[i] = want[j]
    scan = neighbours.DensityScan(df, ["a", "b"], eps)
    got = {r["id"]: r["cluster"] for r in scan.clusters(least, ["id"]).collect()}
    assert {(g, w) for g, w in ((got[i], want[i]) for i in range(n))} == {(got[i], want[i]) for i in range(n)}
    pairs = {(got[i], int(want[i])) for i in range(n)}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})
    assert all((g == -1) == (w == -1) for g, w in pairs)


def test_connected_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "pid bigint")
    links = [(i, i + 1) for i in range(29)] + [(i, i + 1) for i in range(30, 59)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "u bigint, v bigint")
    got = {r["pid"]: r["label"] for r in neighbours.connected(nodes, edges).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 60)} == {30}


def test_oversampling_fills_classes_inside_their_segments(spark):
    rng = np.random.default_rng(1)
    small = np.concatenate([rng.normal(0, 1, (25, 2)), np.zeros((8, 2))])
    rows = [(float(a), float(b), "s") for a, b in small] + [(float(a), float(b), "b") for a, b in rng.normal(5, 1, (80, 2))]
    rows += [(9.0, 9.0, "lonely")]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    out = resample.oversample(df, ["a", "b"], "y", mark="made").collect()
    sizes = {}
    for r in out:
        sizes[r["y"]] = sizes.get(r["y"], 0) + 1
    assert sizes == {"s": 80, "b": 80, "lonely": 1}
    d = gaps(small)
    for r in (r for r in out if r["made"]):
        p = np.array([r["a"], r["b"]])
        ok = False
        for i in range(len(small)):
            for j in np.argsort(d[i], kind="stable")[:7]:
                ab, ap = small[j] - small[i], p - small[i]
                t = 0.0 if not ab.any() else ap @ ab / (ab @ ab)
                if -1e-9 <= t <= 1 + 1e-9 and np.allclose(small[i] + t * ab, p, atol=1e-9):
                    ok = True
        assert ok
    again = {(r["a"], r["b"], r["y"]) for r in resample.oversample(df.repartition(3), ["a", "b"], "y").collect()}
    assert again == {(r["a"], r["b"], r["y"]) for r in out}


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_linkage_finds_separate_groups(cloud, linkage):
    df, pts = cloud
    clean = df.where((F.col("id") < 270) | (F.col("id") >= 300))
    out = cluster.hierarchical(clean, ["a", "b"], 3, linkage, micro=500).transform(clean).collect()
    groups = {}
    for r in out:
        home = 0 if r["id"] < 90 or r["id"] >= 300 else 1 if r["id"] < 180 else 2
        groups.setdefault(r["cluster"], set()).add(home)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_single_cluster_has_no_silhouette(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, cluster int")
    assert cluster_metrics.silhouette(df, ["a"]).first()["silhouette"] is None
    assert cluster_metrics.silhouette_squared(df, ["a"]).first()["silhouette"] is None


@pytest.mark.parametrize("rows,tile,held", [(10_000, 1000, 2_000_000), (50, 7, 60)])
def test_euclidean_silhouette_beside_all_pairs(spark, monkeypatch, rows, tile, held):
    monkeypatch.setattr(cluster_metrics, "TILE_ROWS", tile)
    monkeypatch.setattr(cluster_metrics, "SUMS_HELD", held)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, (80, 2)) for c in (0, 4, 9)] + [np.full((3, 2), 20.0), np.full((1, 2), -9.0)])
    of = [0] * 80 + [1] * 80 + [2] * 80 + [3] * 3 + [4]
    df = spark.createDataFrame([(i, float(a), float(b), c, "x") for i, ((a, b), c) in enumerate(zip(x, of))] + [(999, None, 1.0, 0, "x"), (998, 1.0, 1.0, None, "x")], "id int, a double, b double, cluster int, row string").repartition(4)
    d, of = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.array(of)
    def one(i):
        others = [d[i][of == c].mean() for c in set(of) - {of[i]}]
        n = (of == of[i]).sum()
        a, b = d[i][of == of[i]].sum() / max(1, n - 1), min(others)
        return 0.0 if n == 1 else (b - a) / max(a, b)
    hashed = sorted((int(hashlib.md5(f"silhouette{i}".encode()).hexdigest()[:13], 16), i) for i in range(len(x)))[:rows]
    got = cluster_metrics.silhouette(df, ["a", "b"], ["id"], rows=rows).first()["silhouette"]
    assert got == pytest.approx(np.mean([one(i) for _, i in hashed]))


@pytest.mark.parametrize("dealt", [20_000, 40])
def test_sums_sent_for_a_silhouette_do_not_grow_with_the_clusters(spark, monkeypatch, dealt):
    monkeypatch.setattr(cluster_metrics, "DEALT_ROWS", dealt)
    rng = np.random.default_rng(4)
    x, of = rng.normal(0, 5, (900, 2)), np.concatenate([np.repeat(np.arange(400), 2), np.full(100, 400)])
    held = spark.createDataFrame([([float(a), float(b)], int(c), i) for i, ((a, b), c) in enumerate(zip(x, of))], "x array<double>, cluster int, h bigint").repartition(8)
    sums = cluster_metrics.sample_sums(held, x[:50], of[:50].astype(object)).collect()
    tasks, parts = (1, 0) if dealt > 900 else (23, 23)
    assert len(sums) <= 50 * (1 + tasks + parts)
    for i in range(50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        got = {}
        for r in sums:
            if r["row"] == i:
                total, n = got.get(r["other"], (0.0, 0))
                got[r["other"]] = total + r["total"], n + r["n"]
        assert got[of[i]] == (pytest.approx(d[of == of[i]].sum()), 2)
        want = min(d[of == c].mean() for c in set(of) - {of[i]})
        assert min(t / n for c, (t, n) in got.items() if c != of[i]) == pytest.approx(want)


def test_centre_blocks_do_not_change_davies_bouldin(cloud, monkeypatch):
    df, _ = cloud
    df = df.withColumn("cluster", F.pmod("id", F.lit(7)).cast("int"))
    whole = cluster_metrics.davies_bouldin(df, ["a", "b"]).first()
    monkeypatch.setattr(cluster_metrics, "CENTRE_BLOCK", 2)
    parts = cluster_metrics.davies_bouldin(df, ["a", "b"]).first()
    assert whole["clusters"] == 7 and parts["davies_bouldin"] == pytest.approx(whole["davies_bouldin"])


def _scattered(spark, n, dims, seed=5):
    rng = np.random.default_rng(seed)
    cols = [f"c{i}" for i in range(dims)]
    x = rng.normal(0, 1, (n, dims))
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)), cols


def test_directionless_points_are_sent_to_tiles_not_to_every_cell(spark):
    _, df, cols = _scattered(spark, 900, 16)
    points = neighbours.weighted_points(df, cols)
    pivots = neighbours.choose_pivots(points)
    a, b = neighbours._blocks(neighbours.assign(points, pivots), points, pivots, np.full(len(pivots), 100.0), ["w"])
    assert a.count() == b.count() == 900


def test_tiles_find_the_same_neighbours_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 150)
    monkeypatch.setattr(neighbours, "STRIP_ROWS", 40)
    x, df, cols = _scattered(spark, 500, 12)
    d = neighbours.distances(x, x)
    got = {r["id"]: r["distance"] for r in neighbours.neighbour_distance(df, cols, 5, ["id"]).collect()}
    assert got == {i: v for i, v in enumerate(np.sort(d, axis=1)[:, 4])}
    scan = neighbours.DensityScan(df, cols, 2.6)
    around = {tuple(r["x"]): r["around"] for r in scan.points.collect()}
    assert all(around[tuple(v)] == n for v, n in zip(x, (d <= 2.6).sum(axis=1)))


@pytest.mark.parametrize("dims", [1, 2, 9, 64])
def test_screens_leave_plain_distances_as_they_are(dims, monkeypatch):
    """Pairs are screened by products in single precision, in any number of dimensions; few are measured plainly."""
    rng = np.random.default_rng(dims)
    measured, paired = [], neighbours._paired
    monkeypatch.setattr(neighbours, "_paired", lambda a, b: measured.append(len(a)) or paired(a, b))
    for scale, off in ((1.0, 0.0), (1e-20, 0.0), (1e19, 0.0), (1.0, 1e3), (1.0, 1e9)):
        b = rng.normal(size=(600, dims)) * scale + off * scale
        a = np.concatenate([b[:30], rng.normal(size=(30, dims)) * scale + off * scale])
        d = neighbours.distances(a, b)
        measured.clear()
        assert (np.sort(neighbours.closest(a, b, 5)[1], axis=1) == np.sort(d, axis=1)[:, :5]).all()
        for eps in (0.0, *np.quantile(d, [0.001, 0.2]), d[40, 7]):
            assert (neighbours.within(a, b, eps) == (d <= eps)).all()
        if off == 0 and scale == 1:
            assert len(measured) == 5 and sum(measured) < 0.05 * d.size


@pytest.mark.parametrize("most", [0, 50, 10**6])
def test_links_of_a_block_give_its_components(monkeypatch, most):
    monkeypatch.setattr(neighbours, "LISTED", most)
    monkeypatch.setattr(neighbours, "STRIP_ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.permutation(np.concatenate([np.arange(200) * 0.9, 1000 + np.arange(60) * 0.9, [500.0]]))[:, None]
    labels = np.arange(len(x)) * 3 + 5
    left, right = neighbours.starred(x[:150], x[100:], labels[:150], labels[100:], 1.0)
    got, hit = np.full(len(x), -1), neighbours.distances(x, x) <= 1.0
    want = labels.copy()
    side = np.zeros_like(hit)
    side[:150, 100:] = True
    hit &= side | side.T
    for _ in range(len(x)):
        want = np.where(hit | np.eye(len(x), dtype=bool), want[None, :], 10**6).min(axis=1)
    got[:150], got[100:] = left, right
    assert (got == want).all() and (left[100:] == right[:50]).all()


def test_components_of_a_long_chain_hand_on_no_inferred_columns(spark):
    """A checkpointed round hands on twice what was inferred of the round before, until the driver is full."""
    n = 600
    nodes = spark.range(n).select(F.col("id").alias("pid"))
    link = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = neighbours.connected(nodes, link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    assert {tuple(r) for r in found.groupBy("label").count().collect()} == {(0, n)}
    assert found._jdf.queryExecution().analyzed().constraints().size() < 10
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith(("heard", "jumped"))]


def test_all_starts_of_k_means_share_their_passes(spark):
    """100 starts one by one take thousands of jobs; rows far from zero and equal rows are measured as exactly as others."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in [(0, 0), (6, 6), (0, 7)]] + [np.full((40, 2), 3.0)]) + 1e6
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(4)
    spark.sparkContext.setJobGroup("starts", "starts")
    curve, models = cluster.kmeans_sweep(df, ["a", "b"], ks=range(2, 12))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts")) < 400
    assert [r["inertia"] for r in curve.orderBy("k").collect()] == sorted((m.inertia for m in models.values()), reverse=True)
    for k in (2, 4, 11):
        d = ((x[:, None] - models[k].centres[None]) ** 2).sum(axis=2)
        assert models[k].inertia == pytest.approx(d.min(axis=1).sum(), rel=1e-6)
        of = d.argmin(axis=1)
        pairs = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        to = np.stack([pairs[:, of == c].sum(axis=1) / max(1, (of == c).sum()) for c in range(k)], axis=1)
        size = np.bincount(of, minlength=k)[of]
        a = to[np.arange(len(x)), of] * size / np.maximum(1, size - 1)
        to[np.arange(len(x)), of] = np.inf
        b = to.min(axis=1)
        want = np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean()
        assert models[k].silhouette == pytest.approx(want, rel=1e-6)
        assert cluster_metrics.silhouette_squared(models[k].transform(df), ["a", "b"]).first()["silhouette"] == pytest.approx(want, rel=1e-6)
    again = cluster.fit_kmeans(df.repartition(3), ["a", "b"], 4)
    assert again.centres == pytest.approx(models[4].centres) and models[4].inertia < 200


def test_discovery_fits_its_micro_clusters_once_and_keeps_the_better_of_all(spark, monkeypatch):
    calls = []
    whole = cluster.KMeans.fit
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, data: calls.append(self.getK()) or whole(self, data))
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.3, (120, 2)) for c in [(0, 0), (5, 5), (0, 6)]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    won = cluster.discover(df, ["a", "b"])
    assert calls == [300]
    tried = {r["name"]: r["silhouette"] for r in won.candidates.collect()}
    assert {"kmeans k=3", "hierarchical ward", "hierarchical complete", "hierarchical average"} <= set(tried)
    assert won.silhouette == max(tried.values()) and won.labelled.count() == 360
