from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardenframe.operators import causes as ca
from wardenframe.operators import clusters as cu
from wardenframe.operators import evaluation as evl
from wardenframe.operators import forest as fo
from wardenframe.operators import gaussian as ga


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 0.5]])
    x[:3] += 12
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")


def test_gaussian_equals_numpy(cloud):
    x, df = cloud
    centred = x - x.mean(axis=0)
    n, p = x.shape
    s = centred.T @ centred / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((np.square(centred).sum(axis=1) ** 2).sum() / n - (s**2).sum()) / (p * n), delta)
    cov = (1 - beta / delta) * s + beta / delta * mu * np.eye(p) + 1e-6 * np.eye(p)
    want = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
    got = ga.detect(df, ["a", "b", "c"], ["id"]).orderBy("id").toPandas()
    assert np.allclose(got.gaussian_score, want)
    assert np.isclose(got.bayesian_threshold[0], np.quantile(want, 0.95))
    assert (got.bayesian_anomaly == (want >= np.quantile(want, 0.95))).all()
    assert got.bayesian_probability.between(0, 1).all() and got.bayesian_probability.max() == 1


def test_forest_finds_planted_outliers_and_repeats(cloud):
    _, df = cloud
    first = fo.detect(df, ["id"], ["a", "b", "c"], trees=40, contamination=0.01).toPandas()
    assert set(first.nlargest(3, "anomaly_score").id) == {0, 1, 2}
    assert first.is_anomaly.sum() == 6 and (first.prediction == -1).sum() == 6
    again = fo.detect(df.repartition(5), ["id"], ["a", "b", "c"], trees=40, contamination=0.01).toPandas()
    merged = first.merge(again, on="id")
    assert np.allclose(merged.anomaly_score_x, merged.anomaly_score_y)


def test_forest_samples_are_bounded_and_without_repeats(cloud, spark):
    _, df = cloud
    small = fo.tree_samples(df, ["id"], ["a", "b", "c"], trees=10, sample=256, seed=1).groupBy("tree").agg(F.count("a").alias("n"), F.countDistinct("a").alias("d")).collect()
    assert {(r.n, r.d) for r in small} == {(256, 256)} and len(small) == 10
    dealt = fo.tree_samples(df, ["id"], ["a", "b", "c"], trees=4, sample=100, seed=1).groupBy("tree").agg(F.countDistinct("a").alias("d")).collect()
    assert {r.d for r in dealt} == {100}


def test_cluster_distance_is_to_the_own_centre(cloud):
    x, df = cloud
    model = cu.fit_clusters(df, ["a", "b", "c"], k=3)
    got = cu.assign(df, model, ["a", "b", "c"], ["id"]).orderBy("id").toPandas()
    centres = np.array(model.clusterCenters())
    assert np.allclose(got.cluster_distance, np.linalg.norm(x - centres[got.cluster_id], axis=1))
    assert got.cluster_anomaly_score.min() == 0 and got.cluster_anomaly_score.max() == 1 and not got.cluster_anomaly.any()


def test_all_starts_advance_together(spark):
    """As good as Spark's own clustering, one fit after the other, with no more jobs for more starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(6)
    centres = rng.normal(scale=8, size=(4, 3))
    points = np.concatenate([c + rng.normal(size=(150, 3)) for c in centres])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double, c double").repartition(4)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    loop = min(KMeans(k=4, seed=42 + i, maxIter=300).fit(vectors).summary.trainingCost for i in range(5))
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for starts in (1, 10):
        spark.sparkContext.setJobGroup(f"starts-{starts}", "k-means")
        model = cu.fit_clusters(df, ["a", "b", "c"], k=4, starts=starts)
        jobs[starts] = len(tracker.getJobIdsForGroup(f"starts-{starts}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    nearest = ((points[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert np.isclose(model.cost, nearest) and model.cost <= loop * (1 + 1e-6)
    assert jobs[10] <= jobs[1] + 12  # rounds until the slowest start stands still, not fits


def test_rounds_over_a_table_in_one_file_are_shared_out(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cu, "materialise", lambda df, label, keep=cu.materialise: written.append(keep(df, label)) or written[-1])
    points = np.random.default_rng(4).normal(size=(50_000, 2)) + np.repeat([[0.0, 0.0], [40.0, 40.0]], 25_000, axis=0)
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"])).coalesce(1)
    model = cu.fit_clusters(df, ["a", "b"], k=2, starts=2)
    by_task = written[0].groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 50_000 and len(by_task) > 1 and max(r["count"] for r in by_task) <= cu.ROWS_PER_TASK
    centres = model.centres[np.argsort(model.centres[:, 0])]
    assert np.allclose(centres, [points[:25_000].mean(axis=0), points[25_000:].mean(axis=0)])


def test_rounds_read_blocks_of_all_rows(spark, monkeypatch):
    """A round hands Python blocks, not rows, and adds up what a plain loop does, ties to the first centre."""
    written = {}
    monkeypatch.setattr(cu, "materialise", lambda df, label, keep=cu.materialise: written.setdefault(label, keep(df, label)))
    points = np.random.default_rng(8).normal(size=(9_000, 3)).round(1)
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b", "c"])).coalesce(1)
    cu.fit_clusters(df, ["a", "b", "c"], k=2, starts=2)
    blocks = written["cluster-blocks"]
    inside = np.concatenate([np.frombuffer(r["block"]).reshape(-1, 3) for r in blocks.collect()])
    assert blocks.count() <= 4 and np.array_equal(inside[np.lexsort(inside.T)], points[np.lexsort(points.T)])
    centres = {3: np.array([[0.0, 0, 0], [1, 0, 0], [1, 0, 0]]), 7: np.array([[-1.0, 0, 0], [0, 2, 0]])}  # rows between two centres, and two alike
    sums, counts, costs = cu._round(blocks, centres)
    for s, c in centres.items():
        far = ((points[:, None] - c[None]) ** 2).sum(axis=2)
        best = far.min(axis=1)
        own = np.array([next(g for g in range(len(c)) if row[g] <= least + 1e-9) for row, least in zip(far, best)])
        clear = (np.sort(far, axis=1)[:, 1] - best > 1e-9).sum()
        assert counts[s].sum() == len(points) and np.isclose(costs[s], best.sum()) and np.allclose(sums[s].sum(axis=0), points.sum(axis=0))
        assert abs(counts[s] - np.bincount(own, minlength=len(c))).max() <= len(points) - clear
    assert counts[3][2] == 0


def test_rounds_over_a_large_table_read_packed_blocks(spark, monkeypatch):
    """Blocks of a large table are compressed and dealt out; a round over them adds up what a plain loop does, however many tasks have sums."""
    written = {}
    monkeypatch.setattr(cu, "materialise", lambda df, label, keep=cu.materialise: written.setdefault(label, keep(df, label)))
    points = np.random.default_rng(9).integers(0, 9, size=(25_000, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b", "c"])).coalesce(1)
    model = cu.fit_clusters(df, ["a", "b", "c"], k=2, starts=2)
    blocks = written["cluster-blocks"]
    assert sum(len(r["block"]) for r in blocks.collect()) < points.nbytes / 3 and blocks.rdd.getNumPartitions() > 1
    inside = np.concatenate([x.T for r in blocks.collect() for x, _ in cu._pieces(r, 3)])
    assert np.array_equal(inside[np.lexsort(inside.T)], points[np.lexsort(points.T)])
    centres = {s: np.random.default_rng(s).uniform(0, 9, size=(n, 3)) for s, n in ((0, 2), (4, 3))}
    for most in (cu.PARTS_FETCHED, 1):
        monkeypatch.setattr(cu, "PARTS_FETCHED", most)
        sums, counts, costs = cu._round(blocks, centres)
        for s, c in centres.items():
            far = ((points[:, None] - c[None]) ** 2).sum(axis=2)
            own = far.argmin(axis=1)
            assert np.array_equal(counts[s], np.bincount(own, minlength=len(c))) and np.isclose(costs[s], far.min(axis=1).sum())
            assert np.allclose(sums[s], [points[own == g].sum(axis=0) for g in range(len(c))])
    far = ((points[:, None] - model.centres[None]) ** 2).sum(axis=2)
    assert np.isclose(model.cost, far.min(axis=1).sum())


def test_place_of_rows_without_a_value(spark):
    """A row that lacks a value has no distance; the others get theirs."""
    df = spark.createDataFrame([("x", 1.0, 2.0), ("y", None, 2.0), ("z", 9.0, 9.0)], "id string, a double, b double")
    got = {r["id"]: r for r in cu.assign(df, cu.PeerGroups(np.array([[0.0, 0], [9, 9]]), 0.0), ["a", "b"], ["id"]).collect()}
    assert got["x"].cluster_id == 0 and np.isclose(got["x"].cluster_distance, 5**0.5) and got["y"].cluster_distance is None
    assert (got["z"].cluster_id, got["z"].cluster_distance) == (1, 0.0)


def test_scaling_of_a_wide_table(spark, monkeypatch):
    """A few columns at a time give what all at once give."""
    from wardenframe.operators import cleaning as cl

    df = spark.createDataFrame([(1.0, 5.0, None, 2.0), (2.0, 5.0, 4.0, 8.0), (4.0, 5.0, 6.0, 9.0)], "a double, b double, c double, d double")
    whole = cl.standard_scale(df, ["a", "b", "c", "d"]).collect()
    monkeypatch.setattr(cl, "WIDE", 2)
    monkeypatch.setattr(cl, "STATS_AT_ONCE", 3)
    assert cl.standard_scale(df, ["a", "b", "c", "d"]).collect() == whole


def test_starts_alike_advance_once():
    a, b = np.array([[1.0, 2], [3, 4]]), np.array([[1.0, 2], [3, 5]])
    assert list(cu._unlike({0: a, 1: b, 2: a[::-1], 3: b})) == [0, 1]


def test_distances_are_written_before_their_quantile(cloud):
    _, df = cloud
    model = cu.PeerGroups(np.array([[0.0, 0, 0], [12, 12, 12]]), 0.0)
    got = cu.assign(df, model, ["a", "b", "c"], ["id"], 0.99)
    assert got.inputFiles() and all("cluster-distances" in f for f in got.inputFiles())
    assert got.where("cluster_anomaly").count() == 6


def test_levelled_trees_are_walked_as_their_nodes_say():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 4)).round(1), np.full((1, 4), np.nan), np.full((1, 4), 50.0)])
    grown = [[tuple(r) for r in fo._grow(x[rng.choice(300, 64)], t, 6, 1).itertuples(index=False)] for t in range(20)]
    grown.append([(20, 0, -1, 0.0, -1, -1, 64, 0)])  # equal points only

    def walk(rows, v):
        node = rows[0]
        while node[2] >= 0:
            node = rows[node[4] if v[node[2]] <= node[3] else node[5]]
        return node[7] + fo.expected_path(node[6])

    want = [sum(walk(rows, v) for rows in grown) for v in x]
    assert np.allclose(fo._paths(x, [fo._levelled(rows, 6) for rows in grown], 6), want, rtol=1e-12)


def test_clusters_of_few_points(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0)], "id long, a double")
    model = cu.fit_clusters(df, ["a"], k=5)
    got = cu.assign(df, model, ["a"], ["id"]).collect()
    assert {r.cluster_distance for r in got} == {0.0} and len({r.cluster_id for r in got}) == 2


def test_model_results_must_cover_the_same_records(spark):
    a = spark.createDataFrame([(1, 0.5)], "id int, s double")
    b = spark.createDataFrame([(1, 2), (2, 3)], "id int, c int")
    assert cu.join_model_results(a, b.where("id = 1"), ["id"]).count() == 1
    with pytest.raises(Exception, match="same records"):
        cu.join_model_results(a, b, ["id"]).collect()


def test_cause_network_equals_enumeration(spark):
    rng = np.random.default_rng(0)
    causes = ["u", "v", "w", "never"]
    rows = [(bool(rng.random() < 0.3), bool(rng.random() < 0.5), bool(rng.random() < 0.2), False, bool(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "u boolean, v boolean, w boolean, never boolean, y boolean")
    net = ca.fit_cause_network(df, causes, "y")
    prior = [(sum(r[i] for r in rows) + 5) / 310 for i in range(3)]
    table, weight = {}, {}
    for bits in product((0, 1), repeat=3):
        hit = [r for r in rows if tuple(map(int, r[:3])) == bits]
        table[bits] = (sum(r[4] for r in hit) + 10 / 16) / (len(hit) + 10 / 8)
        weight[bits] = np.prod([p if b else 1 - p for p, b in zip(prior, bits)])
    base = sum(weight[b] * table[b] for b in table)
    assert np.isclose(net.baseline, base) and net.prior[3] == 0
    with_u = [b for b in table if b[0]]
    assert np.isclose(net.probability(1), sum(weight[b] * table[b] for b in with_u) / sum(weight[b] for b in with_u))
    assert np.isclose(net.posterior(0), sum(weight[b] * table[b] for b in with_u) / base)
    out = ca.apply_cause_network(df, net)
    assert out.count() == 300
    assert all({c.cause for c in r.probable_root_causes} <= {n for n in causes if r[n]} for r in out.collect())


def _enumerated(counts, k, ess=10.0):
    """Baseline, probability by active causes and posterior by cause, over all 2^k patterns."""
    rows, anomalies = sum(n for _, n, _ in counts), sum(a for *_, a in counts)
    yes = [sum(n for p, n, _ in counts if p >> i & 1) for i in range(k)]
    prior = [1.0 if y == rows else 0.0 if y == 0 else (y + ess / 2) / (rows + ess) for y in yes]
    q = 2 ** sum(0 < y < rows for y in yes)
    seen = {p: (n, a) for p, n, a in counts}
    weight, effect = {}, {}
    for p in range(2**k):
        weight[p] = float(np.prod([pr if p >> i & 1 else 1 - pr for i, pr in enumerate(prior)]))
        n, a = seen.get(p, (0, 0))
        effect[p] = (a + ess / (2 * q)) / (n + ess / q) if 0 < anomalies < rows else float(anomalies > 0)
    base = sum(weight[p] * effect[p] for p in weight)

    def probability(active):
        over = [p for p in weight if p & active == active and weight[p] > 0]
        mass = sum(weight[p] for p in over)
        return base if not active or not mass else sum(weight[p] * effect[p] for p in over) / mass
    return base, probability, [sum(weight[p] * effect[p] for p in weight if p >> i & 1) / base if base else 0.0 for i in range(k)]


def test_sparse_network_equals_enumeration_of_ten_causes():
    rng = np.random.default_rng(8)
    for case in range(6):
        patterns = np.unique(rng.integers(0, 1024, 60) & rng.integers(0, 1024, 60)) | (512 if case == 1 else 0)
        if case == 2:
            patterns &= 1023 ^ 4
        counts = [(int(p), int(n), int(rng.integers(0, n + 1)) if case not in (3, 4) else (0 if case == 3 else int(n))) for p in np.unique(patterns) for n in [rng.integers(1, 50)]]
        net = ca.CauseNetwork(counts, [f"c{i}" for i in range(10)])
        base, probability, posterior = _enumerated(counts, 10)
        assert np.isclose(net.baseline, base) and np.allclose([net.posterior(i) for i in range(10)], posterior)
        assert np.allclose([net.probability(p) for p in range(0, 1024, 7)], [probability(p) for p in range(0, 1024, 7)])


def test_network_of_thirty_causes(spark):
    rng = np.random.default_rng(4)
    names = [f"c{i}" for i in range(30)]
    hit = rng.random((400, 30)) < 0.1
    outcome = hit[:, 0] | (rng.random(400) < 0.1)
    df = spark.createDataFrame([(*map(bool, r), bool(y)) for r, y in zip(hit, outcome)], ", ".join(f"{n} boolean" for n in [*names, "y"]))
    net = ca.fit_cause_network(df, names, "y")
    out = ca.apply_cause_network(df, net).collect()
    assert len(out) == 400 and all(0 <= r.bayesian_anomaly_probability <= 1 for r in out)
    assert net.probability(1) > net.baseline and net.posterior(0) > net.prior[0]
    with pytest.raises(ValueError):
        ca.CauseNetwork([(0, 1, 0)], ["c"] * 63)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (0, 0.9)], "t int, s double")
    pairs = [(p, q) for p in (0.9, 0.4) for q in (0.4, 0.1, 0.9)]
    want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)
    assert np.isclose(evl.roc_auc(df, "t", "s").first()[0], want)
    assert evl.roc_auc(df.where("t = 1"), "t", "s").first()[0] is None


def test_correlations_over_rows_that_hold_both(spark):
    import numpy as np
    import pandas as pd

    from wardenframe.operators.profiling import correlation_matrix

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) + 1e6
    x[:, 1] += x[:, 0]
    x[:, 3] = 5.0
    x[rng.random((300, 4)) < 0.2] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in x]
    got = correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"])
    want = pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(got[:3, :3], want[:3, :3], atol=1e-9) and np.isnan(got[3]).all()


def test_repeated_keys_do_not_fan_out(spark):
    import pytest

    from wardenframe.operators.claims import unique_rows

    assert unique_rows(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], "scores").count() == 2
    with pytest.raises(Exception, match="repeated key in scores"):
        unique_rows(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"], "scores").collect()
