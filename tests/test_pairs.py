"""All pairs in blocks, against NumPy, over more points than samples have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panier.operators import clusters as C
from panier.operators import evaluation as E
from panier.operators import experiments as X
from panier.operators import pairs as P
from panier.operators import similarity as S

N = 5200


@pytest.fixture(scope="module")
def many(spark):
    """More than 5,000 points in three clusters, the last two below a tenth of all, and their matrix of distances."""
    rng = np.random.default_rng(7)
    c = np.array([2, 5, 9])[np.minimum(rng.integers(0, 26, N) // 12, 2)]
    c[:5100] = np.where(np.arange(5100) % 50 < 49, 5, 9)
    x = rng.normal(size=(N, 3)) + c[:, None] * np.array([0.1, 0.0, 0.05])
    x[10] = x[11]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    df = spark.createDataFrame([(i, int(c[i]), [float(v) for v in x[i]]) for i in range(N)], "id long, cluster int, v array<double>")
    return df.repartition(3), c, d


def test_means_of_many_points(many):
    df, c, d = many
    own = c[:, None] == c[None]
    off = ~np.eye(N, dtype=bool)
    got = E.separation(P.mean_distances(df, S.euclid)).first()
    assert abs(got.intra - d[own & off].mean()) < 1e-9 and abs(got.inter - d[~own].mean()) < 1e-9
    means = np.array([(d * (c == k)).sum(1) / ((c == k).sum() - (c == k)) for k in (2, 5, 9)])
    x = means[np.searchsorted([2, 5, 9], c), np.arange(N)]
    y = np.where(np.array([2, 5, 9])[:, None] == c, np.inf, means).min(0)
    assert abs(E.silhouette(P.mean_distances(df, S.euclid)).first().silhouette - ((y - x) / np.maximum(x, y)).mean()) < 1e-9


def test_small_clusters_of_many_points(many):
    df, c, d = many
    small = ~np.isin(c, [2])
    assert small.sum() > 5000 and 0 < (~small).sum() < 100
    df = df.withColumn("cluster", F.when(F.col("cluster") == 2, F.when(F.col("id") % 2 == 0, 20).otherwise(21)).otherwise(F.col("id") % 300 + 100).cast("int"))
    large = {k: np.flatnonzero(~small & (np.arange(N) % 2 == k - 20)) for k in (20, 21)}
    least = min(map(len, large.values()))
    assert least > max(np.bincount((np.arange(N) % 300)[small]))
    near = {r.id: r.cluster for r in C.small_clusters(df, least, "reassign", S.euclid).collect()}
    assert all(near[i] == min((round(d[i, large[k]].min(), 9), k) for k in large)[1] for i in range(N) if small[i])
    merged = {r.id: r.cluster for r in C.small_clusters(df, least, "merge_nearest", S.euclid).collect()}
    for g in range(300):
        of = np.flatnonzero(small & (np.arange(N) % 300 == g))
        assert {merged[i] for i in of} == {min((round(d[np.ix_(of, large[k])].mean(), 9), k) for k in large)[1]}


def test_sweep_of_many_points(spark, many):
    df, c, d = many
    assigned = df.select(F.explode(F.expr("sequence(2L, 3L)")).alias("k"), "id").withColumn("cluster", F.col("id") % F.col("k"))
    got = {r.k: r for r in X.sweep_metrics(df.select("id", "v"), assigned).collect()}
    for k in (2, 3):
        own = np.arange(N)[:, None] % k == np.arange(N) % k
        assert abs(got[k].separation - d[~own].mean() / d[own & ~np.eye(N, dtype=bool)].mean()) < 1e-9


def test_blocks(spark, monkeypatch):
    """Several small blocks, sets, names as clusters, a point of two rows, points alone, near points far from the origin."""
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = np.random.default_rng(3)
    sets = [sorted({f"i{v}" for v in rng.integers(0, 40, rng.integers(0, 12))}) for _ in range(90)]
    df = spark.createDataFrame([(i, "abcdefg"[i % 7] if i else "alone", s) for i, s in enumerate(sets)] + [(5, "g", sets[5])], "id long, cluster string, v array<string>")
    want: dict = {}
    rows = [(r.id, r.cluster, set(r.v)) for r in df.collect()]
    for a, ca, va in rows:
        for b, cb, vb in rows:
            if a != b:
                want.setdefault((a, ca, cb), []).append(1 - len(va & vb) / len(va | vb) if va | vb else 0.0)
    got = {(r.a, r.ca, r.cb): (r.m, r.n) for r in P.mean_distances(df, S.jaccard_distance).collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - np.mean(v)) < 1e-6 and got[k][1] == len(v) for k, v in want.items())
    x = np.concatenate([1e6 + rng.normal(size=(30, 4)) * 1e-3, np.ones((10, 4)) * 1e6, -rng.normal(size=(10, 4)) * 1e6])
    pts = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "id long, cluster int, v array<double>")
    for r in P.mean_distances(pts, S.euclid).collect():
        d = [np.linalg.norm(x[r.a] - x[j]) for j in range(50) if j != r.a and j % 2 == r.cb]
        assert abs(r.m - np.mean(d)) < 1e-9 * max(1, np.mean(d))
    with pytest.raises(ValueError):
        P.mean_distances(pts, lambda a, b: a)


def test_average_linkage_in_rounds(spark):
    """Rounds of mutual neighbours, then a matrix, against the matrix alone; some points are equal."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3))
    x[200:220] = x[7]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = C.linkage(300, [(i, j, d[i, j]) for i in range(300) for j in range(i + 1, 300)], "average")
    points = spark.createDataFrame([(i * 3, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    for most in (20, 1, 1000):
        h, a, b = P.average_merges(points, S.euclid, most)
        tree = C.ordered(zip(h, a, b, strict=True), 300)
        assert len(tree) == 299 and np.allclose(tree[:, 2], want[:, 2])
        parts = [{frozenset(np.flatnonzero(c == k)) for k in set(c)} for c in (C.cut(t, 300, clusters=40) for t in (tree, want))]
        assert parts[0] == parts[1]
