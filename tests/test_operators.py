"""Toy fixtures, brute force and properties of the analytics operators."""

import itertools
import json
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panier.functions import text as T
from panier.operators import baskets as B
from panier.operators import clusters as C
from panier.operators import evaluation as E
from panier.operators import itemsets as I
from panier.operators import matching as M
from panier.operators import ml
from panier.operators import similarity as S
from panier.operators.recommend import recommend
from panier.sources import readers, writers

BASKETS = ["abc", "ad", "bce", "abd", "cef", "abcd", "bef", "adg", "bc", "ab"]
SETS = ["a", "b", "c", "d", "e", "ab", "ad", "bc", "ce", "abc"]


@pytest.fixture(scope="module")
def toy(spark):
    return B.from_lists(spark.createDataFrame([(i, list(b)) for i, b in enumerate(BASKETS)], "id long, items array<string>"), "id", "items").cache()


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([(s, list(s)) for s in SETS], "itemset string, items array<string>")


def found(df):
    return {"".join(r["items"]): r["count"] for r in df.collect()}


def test_toy_itemsets(toy):
    assert found(I.item_counts(toy, False, 1)) == dict(a=6, b=7, c=5, d=4, e=3, f=2, g=1)
    assert found(I.pairs_set(toy, 3)) == dict(ab=4, ad=4, bc=4)
    assert found(I.mine(toy, 2, 3).where("k = 3")) == dict(abc=2, abd=2)


def test_toy_multiset(spark):
    one = B.from_lists(spark.createDataFrame([(1, list("aaabbc"))], "id long, items array<string>"), "id", "items")
    assert found(I.item_counts(one, True, 1)) == dict(a=3, b=2, c=1)
    assert found(I.pairs_multiset(one, 1)) == dict(ab=6, ac=3, bc=2, aa=6, bb=2)
    assert found(I.pairs_multiset(one, 1, dedupe_self_pairs=True)) == dict(ab=6, ac=3, bc=2, aa=3, bb=1)
    assert found(I.mine(one, 1, 3, multiset=True).where("k = 3")) == dict(aaa=1, aab=6, aac=3, abb=3, abc=6, bbc=1)
    assert I.described(I.mine(one, 1, 2, multiset=True), 1).where("name = 'a (×2)'").first().support_percentage == "600.00%"


def test_multiset_triples_brute(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(1, 6))]) for i in range(30)]
    x = B.from_lists(spark.createDataFrame(rows, "id long, items array<string>"), "id", "items")
    least = 12
    l1 = {k for k, v in Counter(c for _, b in rows for c in b).items() if v >= least}
    p2 = Counter()
    for _, b in rows:
        n = Counter(c for c in b if c in l1)
        for a, c in itertools.combinations_with_replacement(sorted(n), 2):
            p2[a + c] += n[a] * (n[a] - 1) if a == c else n[a] * n[c]
    p2 = {k: v for k, v in p2.items() if v >= least}
    t3 = Counter()
    for _, b in rows:
        n = Counter(c for c in b if c in l1)
        for t in itertools.combinations_with_replacement(sorted(n), 3):
            m = Counter(t)
            if all("".join(t[:i] + t[i + 1 :]) in p2 for i in range(3)):
                t3["".join(t)] += math.prod(math.comb(min(n[c], 3), k) for c, k in m.items())
    assert found(I.mine(x, least, 3, multiset=True).where("k = 3")) == {k: v for k, v in t3.items() if v >= least}


def test_sets_are_monotone(toy):
    rows = {"".join(r["items"]): r["count"] for r in I.mine(toy, 1, 4).collect()}
    assert all(rows[k] <= rows["".join(s)] for k in rows for s in itertools.combinations(k, len(k) - 1) if s)


def test_toy_containment(toy, sets):
    got = {(r.basket_id, r.itemset) for r in I.containment(toy, sets).collect()}
    assert got == {(i, s) for i, b in enumerate(BASKETS) for s in SETS if set(s) <= set(b)}
    assert [sum(s == x for _, x in got) for s in SETS] == [6, 7, 5, 4, 3, 4, 4, 4, 2, 2]


def jaccard(a, b):
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def test_toy_linkage():
    rows = [{s for s in SETS if set(s) <= set(b)} for b in BASKETS]
    pairs = [(i, j, jaccard(rows[i], rows[j])) for i, j in itertools.combinations(range(10), 2)]
    assert (pairs[0][2], pairs[4][2]) == (0.875, 0.25) and abs(np.mean([p[2] for p in pairs]) - 0.729612) < 1e-6
    tree = C.linkage(10, pairs, "average")
    assert np.allclose(tree[:, 2], [0, 0.25, 0.4, 0.4, 0.5625, 0.6417, 0.675, 0.7381, 0.8631], atol=1e-4)
    two = C.cut(tree, 10, clusters=2)
    assert {frozenset(np.flatnonzero(two == c)) for c in set(two)} == {frozenset({2, 4, 6}), frozenset({0, 1, 3, 5, 7, 8, 9})}
    assert len(set(C.cut(tree, 10, height=0.9))) == 1
    with pytest.raises(ValueError):
        C.cut(tree, 10)
    with pytest.raises(ValueError):
        C.linkage(10, pairs, "none")


@pytest.mark.parametrize("method", C.METHODS)
def test_linkage_brute(method):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tree = C.linkage(14, [(i, j, d[i, j]) for i, j in itertools.combinations(range(14), 2)], method)
    groups, heights = [[i] for i in range(14)], []

    def dist(a, b):
        if method == "ward":
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        v = d[np.ix_(a, b)]
        return {"single": v.min(), "complete": v.max(), "average": v.mean()}[method]

    while len(groups) > 1:
        h, i, j = min((dist(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        heights.append(h)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    assert np.allclose(tree[:, 2], heights)


def test_scores_of_partitions(spark):
    same = spark.createDataFrame([(i % 3, str(i % 3)) for i in range(30)], "cluster long, label string")
    assert E.ari(same).first()[0] == 1 and abs(E.nmi(same).first()[0] - 1) < 1e-12
    a = spark.createDataFrame([(i % 3, str(i % 4)) for i in range(30)] + [(1, "unknown"), (2, None)], "cluster long, label string")
    b = a.where("label <> 'unknown'").select(F.col("label").cast("long").alias("cluster"), F.col("cluster").cast("string").alias("label"))
    assert abs(E.nmi(a).first()[0] - E.nmi(b).first()[0]) < 1e-12 and abs(E.ari(a).first()[0] - E.ari(b).first()[0]) < 1e-12
    assert all(r.purity >= 1 / 4 for r in E.per_cluster(a).collect())


def test_silhouette_brute(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(20, 2)), [i % 3 for i in range(19)] + [7]
    points = spark.createDataFrame([(i, c[i], [float(v) for v in x[i]]) for i in range(20)], "id long, cluster long, v array<double>")
    s = []
    for i in range(20):
        d = lambda k, i=i: [np.linalg.norm(x[i] - x[j]) for j in range(20) if j != i and c[j] == k]
        own, other = d(c[i]), min(np.mean(d(k)) for k in set(c) if k != c[i])
        s.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0)
    assert abs(E.silhouette(E.mean_distances(E.pair_table(points, S.euclid))).first().silhouette - np.mean(s)) < 1e-9
    pairs = {(r.a, r.cb): r.m for r in E.mean_distances(E.pair_table(points, S.cosine_distance)).collect()}
    means = {(r.a, r.cb): r.m for r in E.mean_cosine_distances(points).collect() if r.m is not None}
    assert set(means) == set(pairs) and all(abs(means[k] - pairs[k]) < 1e-9 for k in pairs)
    with pytest.raises(ValueError):
        E.pair_table(points, S.euclid, most=5)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_indel_ratio(spark):
    rng = random.Random(2)
    words = ["olive oil", "virgin olive oil", "", "a", "é à"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(10)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        n = len(r.a) + len(r.b)
        assert abs(r.r - (2 * lcs(r.a, r.b) / n if n else 1)) < 1e-12
    assert dict(((r.a, r.b), round(r.r, 2)) for r in got)["olive oil", "virgin olive oil"] == 0.72


def test_clean(spark):
    rows = [("Crème-Brûlée 2%", "crème brûlée"), ("2 fresh eggs, beaten", "eggs"), ("", ""), (None, ""), ("beaten path", "beaten path"), ("Ground  BEEF (frozen)", "beef")]
    assert [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(T.clean(F.col("x"))).collect()] == [y for _, y in rows]
    T.register(spark)
    assert spark.sql("SELECT clean_name('Crème-Brûlée 2%')").first()[0] == "crème brûlée"


def test_confidences(spark):
    df = spark.createDataFrame([(1.0, True), (0.9, False), (0.7, False), (0.5, False), (0.49, False)], "s double, e boolean")
    assert [r[0] for r in df.select(T.confidence(F.col("s"), F.col("e"))).collect()] == ["very_high", "high", "medium", "low", "very_low"]
    hits = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0), (5, 2.0), (1, 0.4)], "h long, b double")
    assert [round(r[0], 6) for r in hits.select(M.bm25_confidence(F.col("h"), F.col("b"))).collect()] == [1.0, 0.8, 0.7, 0.7, 0.4]


def test_matching(spark):
    names = spark.createDataFrame([("Fresh Olive-Oil",), ("virgin olive oil",), ("zzz",), ("tomato sauce 2%",), (None,)], "name string")
    foods = spark.createDataFrame([("olive oil",), ("tomato paste",)], "food string")
    clusters = spark.createDataFrame([(5, 1, "virgin olive oil"), (6, 2, "tomato sauce")], "cluster_id long, fdc_id long, food_name string")
    got = {(s, r.q): r for s in M.STRATEGIES for r in M.match(names, foods, clusters, s).collect()}
    assert got["adaptive", "olive oil"].method == "exact" and got["adaptive", "olive oil"].confidence == "very_high"
    assert got["adaptive", "virgin olive oil"].cluster_id == 5 and got["db_first", "tomato sauce"].matched == "tomato sauce"
    assert all(got[s, "zzz"].method == "no_match" and got[s, "zzz"].score == 0 for s in M.STRATEGIES)
    with pytest.raises(ValueError):
        M.match(names, foods, clusters, "none")


def test_wide_baskets(spark):
    """Baskets of 300 items: only candidates grow, so five levels are found at once."""
    rows = [(b, f"i{b}x{j:03d}", 1) for b in range(6) for j in range(295)] + [(b, f"c{j}", 1) for b in range(6) for j in range(5)]
    got = I.mine(spark.createDataFrame(rows, "basket_id long, item string, n long"), 4, 5)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {1: 5, 2: 10, 3: 10, 4: 5, 5: 1}


def test_corrections(spark):
    words = spark.createDataFrame([("tomatto",), ("onoin",), ("salt",), ("xyzzy",)], "word string")
    known = spark.createDataFrame([("tomato", 5), ("onion", 3), ("salt", 1), ("malt", 9)], "word string, freq long")
    assert {r.word: r.best for r in M.corrections(words, known).collect()} == {"tomatto": "tomato", "onoin": "onion", "salt": "salt"}


def test_small_clusters(spark):
    points = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [1.0]), (2, 2, [10.0]), (3, 2, [11.0]), (4, 3, [9.0])], "id long, cluster long, v array<double>")
    way = lambda h: {r.id: r.cluster for r in C.small_clusters(points, 2, h, S.euclid).collect()}
    assert way("remove")[4] == -1 and way("outlier_class")[4] == 4 and way("merge_nearest")[4] == 2 and way("reassign")[4] == 2
    with pytest.raises(ValueError):
        way("none")


def test_quotas_and_sample(spark):
    labels = spark.createDataFrame([(i, "abc"[min(2, i % 7)] if i % 11 else "unknown") for i in range(300)], "basket_id long, label string")
    q = {r.label: r for r in C.quotas(labels, 50).collect()}
    assert sum(r.quota for r in q.values()) in range(47, 51) and "unknown" not in q
    s = C.stratified(labels, 50)
    assert {r.label: r["count"] for r in s.groupBy("label").count().collect()} == {k: r.quota for k, r in q.items()}


def test_recommend(spark, toy, sets):
    clusters = spark.createDataFrame([(i, int(i in (2, 4, 6))) for i in range(10)], "basket_id long, cluster long")
    got = {r.basket_id for r in recommend(["a", "b", "c"], toy, I.containment(toy, sets), sets, clusters).collect()}
    assert got == {0, 5}


def test_split_rule():
    assert not C.should_split(9, 1, 1, 5) and C.should_split(10, 0.2, 0.5, 5) and not C.should_split(10, 0.2, 0.2, 5)
    assert C.should_split(10, 0.08, 0.0, 5, have=2, target=5) and not C.should_split(10, 0.08, 0.0, 5, have=5, target=5)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 4)), rng.normal(3, 0.1, (20, 4))])
    p = spark.createDataFrame([(i, str(int(i >= 20)), [float(v) for v in r]) for i, r in enumerate(x)], "id long, label string, v array<double>").cache()
    assert p.count() == 40
    proj = np.array([r.v for r in ml.pca(p, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(proj), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    z = {(r.id, r.j): r.z for r in ml.standardised(p).collect()}
    assert np.allclose([[z[i, j] for j in range(4)] for i in range(40)], (x - x.mean(0)) / x.std(0))
    assert {frozenset(r.id for r in g) for _, g in itertools.groupby(sorted(ml.kmeans(p, 2).collect(), key=lambda r: (r.cluster, r.id)), lambda r: r.cluster)} == {frozenset(range(20)), frozenset(range(20, 40))}
    assert ml.bisecting(p, 1.0).select("cluster").distinct().count() == 2
    tok = spark.createDataFrame([(1, ["a", "b", "?"]), (2, [])], "id long, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token string, v array<double>")
    assert {r.id: r.v for r in ml.token_mean(tok, vec).collect()} == {1: [0.2, pytest.approx(0.3)], 2: None}
    assert ml.concatenated(p, p, drop=2).first().v[2:] != [] and len(ml.concatenated(p, p, drop=2).first().v) == 6


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "food.csv").write_text("description,fdc_id,x\nolive oil,1,a\nsalt,2,b\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    (tmp_path / "third.csv").write_text("food,y\npepper,1\n")
    got = readers.csv(spark, str(tmp_path / "food.csv"), readers.FOOD, {"fdc_id": "fdc_id", "description": "food_name"})
    assert got.dtypes == [("fdc_id", "bigint"), ("food_name", "string")] and got.count() == 2
    assert [r.food for r in readers.csv_glob(spark, [str(tmp_path / f) for f in ("other.csv", "third.csv")]).collect()] == ["pepper"]
    recipes = [{"id": 1, "cuisine": "x", "ingredients": ["a", "b"]}, {"id": 2, "ingredients": []}]
    (tmp_path / "r.json").write_text(json.dumps(recipes, indent=1))
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("in/r.json", json.dumps(recipes))
    a = readers.json_array(spark, str(tmp_path / "r.json"), readers.RECIPE)
    b = readers.json_in_zip(spark, str(tmp_path / "r.zip"), "in/r.json", readers.RECIPE)
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"a + b": {"items": ["a", "b"], "count": 3, "support": 0.5, "support_percentage": "50.00%"}}))
    assert tuple(readers.itemset_dictionary(spark, str(tmp_path / "s.json")).first()) == ("a + b", ["a", "b"], 3, 0.5, 2)
    writers.csv(a, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    z = readers.zipped_lists(spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0])], "id long, x array<string>, y array<double>"), ["id"], ["x", "y"])
    assert [tuple(r) for r in z.collect()] == [(1, 0, "a", 1.0), (1, 1, "b", 2.0)]
    report = writers.cluster_report(spark.createDataFrame([(2, 0.6), (4, 0.2)], "size long, purity double"))
    assert "Clusters: 2" in report and "Purity below 0.3: 1" in report
