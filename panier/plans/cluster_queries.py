"""Sweeps, rankings, profiles and selections over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as C
from ..operators import evaluation as E
from ..operators import experiments as X
from ..operators import itemsets as I
from ..operators import similarity as S
from ..sources import readers
from ..sources.readers import table
from ..sources.scratch import shared_folder
from .analysis_queries import ALL, CT, V, _all, segments, vectors
from .basket_queries import BL, HELD, LEAST, PAIRS, PAIRS_M, WORD, _sets, _words, basket_count, bi, items, labels

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def status(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderstatus").alias("cluster"))


CL = "cl AS (SELECT o_orderkey AS basket_id, o_orderstatus AS cluster FROM orders)"
ASSIGNED = "asg AS (SELECT k, vec_id AS id, (vec_id * 7) % k AS cluster FROM embeddings, (SELECT unnest(range(2, 6)) AS k))"


def assigned(spark, d):
    return table(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("k"), F.col("vec_id").alias("id")).withColumn("cluster", F.col("id") * 7 % F.col("k"))


METRICS = f"""WITH {V}, {ASSIGNED}, pr AS (SELECT x.id AS a, y.id AS b, list_distance(x.v, y.v) AS d FROM vx x JOIN vx y ON x.id <> y.id),
bw AS (SELECT p.k, a, p.cluster AS ca, b, q.cluster AS cb, d FROM pr JOIN asg p ON p.id = a JOIN asg q ON q.id = b AND q.k = p.k),
mn AS (SELECT k, a, ca, cb, avg(d) AS m FROM bw GROUP BY ALL), si AS (SELECT k, a, max(CASE WHEN ca = cb THEN m END) AS x, min(CASE WHEN ca <> cb THEN m END) AS y FROM mn GROUP BY 1, 2),
s1 AS (SELECT k, avg(CASE WHEN x IS NULL OR y IS NULL OR greatest(x, y) = 0 THEN 0 ELSE (y - x) / greatest(x, y) END) AS silhouette FROM si GROUP BY 1),
s2 AS (SELECT k, avg(CASE WHEN ca <> cb THEN d END) / avg(CASE WHEN ca = cb THEN d END) AS separation FROM bw GROUP BY 1),
lg AS (SELECT k, asg.cluster, unnest(range(0, 64)) AS j, unnest(v) AS x FROM vx JOIN asg USING (id)), g AS (SELECT k, j, avg(x) AS g FROM lg GROUP BY 1, 2), c AS (SELECT k, cluster, j, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM lg GROUP BY 1, 2, 3),
s3 AS (SELECT k, (sum(n * (m - g) ^ 2) / (k - 1)) / (sum(w) / ((SELECT count(*) FROM vx) - k)) AS ch FROM c JOIN g USING (k, j) GROUP BY k),
me AS (SELECT k, silhouette, ch, separation FROM s1 JOIN s2 USING (k) JOIN s3 USING (k))"""


@query(f"{METRICS} SELECT k, round(silhouette, 6) AS silhouette, round(ch, 6) AS ch, round(separation, 6) AS separation FROM me")
def sweep_metrics(spark, d):
    return rounded(X.sweep_metrics(vectors(spark, d).select("id", "v"), assigned(spark, d)), "silhouette", "ch", "separation")


@query(f"{METRICS}, lo AS (SELECT k, 'silhouette' AS metric, silhouette AS value FROM me UNION ALL SELECT k, 'ch', ch FROM me UNION ALL SELECT k, 'separation', separation FROM me) SELECT metric, arg_min(k, (-round(value, 9), k)) AS k, round(max(value), 6) AS value FROM lo GROUP BY 1")
def sweep_best(spark, d):
    return rounded(X.best_by_metric(X.sweep_metrics(vectors(spark, d).select("id", "v"), assigned(spark, d))), "value")


@query()
def k_sweep(spark, d):
    """The average-linkage tree of a stated sample (ids below 300) cut into 2 to 6 clusters."""
    return rounded(X.k_sweep(vectors(spark, d).where("id < 300").select("id", "v"), 6), "silhouette", "ch", "separation")


@query()
def experiment_sweep(spark, d):
    """Two strategies, sizes 2 and 3, 4 and 8 clusters, over a stratified sample of 200 orders."""
    x = items(spark, d, WORD)
    out = X.sweep(x, labels(spark, d), I.mine(x, LEAST, 3), basket_count(spark, d), ("coverage", "top_support"), (2, 3), (4, 8), 200)
    return rounded(X.combined_ranking(out, ["strategy", "size", "k"]), "ari", "nmi", "purity", "combined")


AGREE = """asg AS (SELECT k, kind, c_custkey AS id, CASE kind WHEN 'nation' THEN c_nationkey % k ELSE (c_custkey % 97) % k END::BIGINT AS cluster, c_mktsegment AS label FROM customer, (SELECT unnest(range(2, 6)) AS k), (SELECT unnest(['nation', 'key']) AS kind)),
ct AS (SELECT kind, k, cluster, label, count(*)::DOUBLE AS c FROM asg GROUP BY ALL), xy AS (SELECT *, sum(c) OVER (PARTITION BY kind, k, cluster) AS x, sum(c) OVER (PARTITION BY kind, k, label) AS y, sum(c) OVER (PARTITION BY kind, k) AS n FROM ct),
ag AS (SELECT kind, k, any_value(n) AS n, sum(c * (c - 1) / 2) AS s, sum(c * (x - 1) / 2) AS a, sum(c * (y - 1) / 2) AS b, sum(c / n * ln(c * n / (x * y))) AS mi, -sum(c / n * ln(x / n)) AS hu, -sum(c / n * ln(y / n)) AS hv FROM xy GROUP BY 1, 2),
pu AS (SELECT kind, k, avg(p) AS purity FROM (SELECT kind, k, cluster, max(c) / max(x) AS p FROM xy GROUP BY 1, 2, 3) GROUP BY 1, 2),
re AS (SELECT kind, k, (s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) AS ari, 2 * mi / (hu + hv) AS nmi, purity FROM ag JOIN pu USING (kind, k)),
rk AS (SELECT *, (ari + nmi + purity) / 3 AS combined, row_number() OVER (ORDER BY round((ari + nmi + purity) / 3, 9) DESC, kind, k) AS rank FROM re)"""


def _ranked(spark, d):
    c = table(spark, d, "customer")
    a = c.select(F.explode(F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("k"), F.col("c_custkey").alias("id"), "c_nationkey")
    a = a.withColumn("kind", F.explode(F.array(F.lit("nation"), F.lit("key"))))
    a = a.withColumn("cluster", F.when(F.col("kind") == "nation", F.col("c_nationkey")).otherwise(F.col("id") % 97) % F.col("k"))
    return X.combined_ranking(X.agreement(a.select("kind", "k", "id", "cluster"), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), ["kind", "k"]), ["kind", "k"])


@query(f"WITH {AGREE} SELECT kind, k, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(purity, 6) AS purity, round(combined, 6) AS combined, rank FROM rk")
def combined_ranking(spark, d):
    return rounded(_ranked(spark, d), "ari", "nmi", "purity", "combined")


@query(f"WITH {AGREE} SELECT k, round(avg(combined), 6) AS avg_combined, round(max(combined), 6) AS max_combined FROM rk GROUP BY 1")
def ranking_by_size(spark, d):
    return rounded(X.summary_by(_ranked(spark, d), "k"), "avg_combined", "max_combined")


RANKED = ("match_rate", "clustering_rate", "high_confidence_rate", "avg_score")


@query(
    f"{ALL}, st AS (SELECT strategy, avg((method <> 'no_match')::INT) AS match_rate, avg((cluster_id >= 0)::INT) AS clustering_rate, avg((confidence IN ('very_high', 'high'))::INT) AS high_confidence_rate, avg(score) AS avg_score FROM al GROUP BY 1), "
    f"lo AS ({' UNION ALL '.join(f'''SELECT strategy, '{m}' AS metric, {m} AS value FROM st''' for m in RANKED)}) SELECT strategy, metric, round(value, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC, strategy) AS rank FROM lo"
)
def metric_rankings(spark, d):
    from ..operators.matching import statistics

    return rounded(X.metric_rankings(statistics(_all(spark, d)), "strategy", list(RANKED)), "value")


PAIRS_OF = [("A", "F"), ("N", "F"), ("N", "O"), ("R", "F")]


@query("SELECT l_linenumber::BIGINT AS l_linenumber, " + ", ".join(f"round(avg(CASE WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN l_quantity END), 6) AS \"{a}_{b}\"" for a, b in PAIRS_OF) + " FROM lineitem GROUP BY 1")
def pivot_two_level(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    out = X.pivot_mean(rows, "l_linenumber", ["l_returnflag", "l_linestatus"], F.col("l_quantity"), PAIRS_OF)
    return rounded(out, *[f"{a}_{b}" for a, b in PAIRS_OF])


@query(
    f"WITH {bi(WORD)}, {PAIRS.format(least=LEAST)}, m2 AS (SELECT * FROM (WITH {PAIRS_M.format(least=LEAST)} SELECT * FROM p2)), u AS (SELECT x || ' + ' || y AS itemset, x, y, count, 0 AS list FROM p2 UNION ALL SELECT y || ' + ' || x, x, y, count, 1 FROM m2) "
    "SELECT itemset, count, list FROM u QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY list, count DESC, itemset) = 1"
)
def itemsets_union_sizes(spark, d):
    """Pairs of sets, then those of multisets written the other way round: the first of each combination stays."""
    x = items(spark, d, WORD)
    turned = I.pairs_multiset(x, LEAST).withColumn("items", F.reverse("items"))
    return I.union_of_sizes([I.pairs_set(x, LEAST), turned]).select(F.array_join("items", " + ").alias("itemset"), "count", F.col("list"))


@query(HELD + ", nb AS (SELECT count(DISTINCT basket_id) AS baskets FROM bi), ns AS (SELECT count(*) AS itemsets FROM r WHERE rank <= 20), o AS (SELECT count(*) AS ones FROM (SELECT DISTINCT * FROM held)) SELECT baskets, itemsets, ones, round(1 - ones / (baskets::DOUBLE * itemsets), 6) AS sparsity FROM nb, ns, o")
def feature_sparsity(spark, d):
    x = _words(spark, d)
    sets = _sets(spark, d, x)
    return rounded(I.sparsity(I.containment(x, sets), x, sets), "sparsity")


@query(f"WITH {bi()}, {BL}, c AS (SELECT label, a.item AS x, b.item AS y, sum(CASE WHEN a.item = b.item THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END)::BIGINT AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND (a.item < b.item OR (a.item = b.item AND a.n > 1)) JOIN bl ON a.basket_id = bl.basket_id GROUP BY 1, 2, 3) SELECT label, x || ' + ' || y AS combo, count, row_number() OVER (PARTITION BY label ORDER BY count DESC, x, y) AS rank FROM c QUALIFY rank <= 10")
def top_combos_repeats(spark, d):
    return I.top_combos(items(spark, d), labels(spark, d), 2, 10, repeats=True).select("label", F.array_join("combo", " + ").alias("combo"), "count", "rank")


@query(f"WITH {bi('p_brand')}, {BL}, c AS (SELECT label, a.item AS x, b.item AS y, c.item AS z, count(*) AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item JOIN bi c ON b.basket_id = c.basket_id AND b.item < c.item JOIN bl ON a.basket_id = bl.basket_id GROUP BY 1, 2, 3, 4) SELECT label, x || ' + ' || y || ' + ' || z AS combo, count, row_number() OVER (PARTITION BY label ORDER BY count DESC, x, y, z) AS rank FROM c QUALIFY rank <= 10")
def top_combos_triples(spark, d):
    return I.top_combos(items(spark, d, "p_brand"), labels(spark, d), 3, 10).select("label", F.array_join("combo", " + ").alias("combo"), "count", "rank")


@query(f"WITH {CT}, a AS (SELECT cluster FROM ct GROUP BY 1 ORDER BY sum(c) DESC, 1 LIMIT 10), b AS (SELECT label FROM ct GROUP BY 1 ORDER BY sum(c) DESC, 1 LIMIT 3) SELECT cluster, label, c FROM ct WHERE cluster IN (FROM a) AND label IN (FROM b)")
def heatmap_top(spark, d):
    return C.top_by_top(segments(spark, d), "cluster", 10, "label", 3).groupBy("cluster", "label").agg(F.count("*").alias("c"))


@query(f"WITH {bi(WORD)}, {CL}, z AS (SELECT cluster, count(*) AS size FROM cl GROUP BY 1), c AS (SELECT cluster, item, count(*) AS count FROM bi JOIN cl USING (basket_id) GROUP BY 1, 2) SELECT cluster, item, count, round(count / size, 6) AS share, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, item) AS rank FROM c JOIN z USING (cluster) QUALIFY rank <= 10")
def cluster_top_items(spark, d):
    return rounded(C.item_profile(items(spark, d, WORD), status(spark, d)), "share")


@query(f"WITH {bi()}, {CL}, s AS (SELECT basket_id, sum(n) AS size FROM bi GROUP BY 1) SELECT cluster, count(*) AS baskets, round(avg(coalesce(size, 0)), 6) AS avg_items FROM cl LEFT JOIN s USING (basket_id) GROUP BY 1")
def cluster_basket_sizes(spark, d):
    return rounded(C.cluster_sizes(items(spark, d), status(spark, d)), "avg_items")


@query(f"WITH {bi()}, {CL}, f AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY basket_id) <= 5), h AS (SELECT cluster, basket_id, list_sort(list(item)) AS l FROM bi JOIN f USING (basket_id) GROUP BY 1, 2) SELECT cluster, basket_id, array_to_string(l[1:8], ', ') AS items, len(l)::INT AS n_items FROM h")
def cluster_sample_head(spark, d):
    return C.sample_head(items(spark, d), status(spark, d)).withColumn("items", F.array_join("items", ", "))


@query(
    HELD + f", {CL}, m AS (SELECT cluster, itemset, count(*) AS c FROM held JOIN cl USING (basket_id) GROUP BY 1, 2), f AS (SELECT cluster, itemset, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, itemset) AS rank FROM m), "
    "x AS (SELECT list_sort(list(itemset)) AS l FROM f WHERE cluster = 'F' AND rank <= 5), y AS (SELECT list_sort(list(itemset)) AS l FROM f WHERE cluster = 'P' AND rank <= 5) "
    "SELECT array_to_string(list_filter(x.l, lambda v: list_contains(y.l, v)), '; ') AS common, array_to_string(list_filter(x.l, lambda v: NOT list_contains(y.l, v)), '; ') AS only_one, array_to_string(list_filter(y.l, lambda v: NOT list_contains(x.l, v)), '; ') AS only_two FROM x, y"
)
def cluster_differences(spark, d):
    x = _words(spark, d)
    p = C.profile(I.containment(x, _sets(spark, d, x)), status(spark, d), least=2.0)
    return C.differences(p, "F", "P").select(*[F.array_join(c, "; ").alias(c) for c in ("common", "only_one", "only_two")])


@query(f"WITH {CT}, n AS (SELECT sum(c)::DOUBLE AS n FROM ct), xy AS (SELECT *, sum(c) OVER (PARTITION BY cluster)::DOUBLE AS x, sum(c) OVER (PARTITION BY label)::DOUBLE AS y FROM ct), t AS (SELECT any_value(n.n) AS n, sum(c * (c - 1) / 2.0) AS s, sum(c * (x - 1) / 2) AS a, sum(c * (y - 1) / 2) AS b, sum(c / n.n * ln(c * n.n / (x * y))) AS mi, -sum(c / n.n * ln(x / n.n)) AS hu, -sum(c / n.n * ln(y / n.n)) AS hv FROM xy, n), p AS (SELECT avg(p) AS mean_purity, count(*) AS clusters, sum(z)::BIGINT AS total FROM (SELECT max(c) / sum(c) AS p, sum(c) AS z FROM ct GROUP BY cluster)) SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (hu + hv), 6) AS nmi, round(mean_purity, 6) AS mean_purity, clusters, total FROM t, p")
def final_evaluation(spark, d):
    return rounded(C.final_evaluation(segments(spark, d)), "ari", "nmi", "mean_purity")


@query(f"WITH {CT} SELECT cluster, sum(c)::BIGINT AS size, arg_min(label, (-c, label)) AS dominant, round(max(c) / sum(c), 6)::DOUBLE AS purity, row_number() OVER (ORDER BY sum(c) DESC, cluster) AS rank FROM ct GROUP BY 1 QUALIFY rank <= 10")
def largest_clusters(spark, d):
    return rounded(C.largest(segments(spark, d)), "purity")


SEGMENTS = ["MACHINERY", "AUTOMOBILE", "FURNITURE", "BUILDING"]


@query("SELECT c_mktsegment AS label, count(*) AS customers, CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS)) + " ELSE 4 END AS ord FROM customer GROUP BY 1")
def custom_label_order(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("customers"))
    return S.in_order(n, "label", SEGMENTS).orderBy("ord", "label")


@query(f"WITH {V}, b AS (SELECT id, list_transform(v, lambda x: x > 0) AS v FROM vx WHERE id < 200) SELECT x.id AS a, y.id AS b, round(len(list_filter(list_zip(x.v, y.v), lambda p: p[1] <> p[2])) / 64.0, 6)::DOUBLE AS d FROM b x JOIN b y ON x.id < y.id")
def hamming_pairs(spark, d):
    """The signs of the vectors of a stated sample, by the distance's name."""
    v = vectors(spark, d).where("id < 200").withColumn("v", F.transform("v", lambda x: x > 0))
    return rounded(E.pair_table(v, S.distance("hamming")).select("a", "b", "d"), "d")


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END, 6) AS c_acctbal FROM customer")
def zero_filled(spark, d):
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", F.round(T.zero_filled(x), 6).alias("c_acctbal"))


@query("SELECT block, count(*) AS rows, min(c_custkey) AS lo, max(c_custkey) AS hi FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT AS block FROM customer) GROUP BY 1")
def chunked_scan(spark, d):
    out = readers.row_blocks(table(spark, d, "customer"), "c_custkey", 4)
    return out.groupBy("block").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query(f"WITH {bi(WORD)}, {PAIRS.format(least=LEAST)} SELECT x || ' + ' || y AS itemset, count FROM p2")
def cached_pairs(spark, d):
    """Computed the first time, read the second."""
    folder = f"{shared_folder(spark)}/panier/results-{spark.sparkContext.applicationId}"
    compute = lambda: I.pairs_set(items(spark, d, WORD), LEAST)
    for _ in range(2):
        out = readers.cached(spark, folder, "pairs", {"least": LEAST, "sf": d}, compute)
    return out.select(F.array_join("items", " + ").alias("itemset"), "count")
