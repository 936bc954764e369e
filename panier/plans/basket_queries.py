"""Wide tables, itemsets, groups and label similarities over orders as baskets of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import groups as G
from ..operators import itemsets as I
from ..operators import similarity as S
from ..sources.readers import table
from ..sources.scratch import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
LEAST = 30
WORD = "split_part(p_name, ' ', 1)"
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def line_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()


def items(spark: SparkSession, d: str, expr: str = "p_name") -> DataFrame:
    return B.basket_items(lines(spark, d), "l_orderkey", F.expr(expr), line_count(spark, d))


def part_items(spark: SparkSession, d: str) -> DataFrame:
    return B.basket_items(table(spark, d, "lineitem"), "l_orderkey", F.col("l_partkey").cast("string"), line_count(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("label"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("o_orderkey").alias("basket_id"), F.col("n_name").alias("label"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return B.last_wins(table(spark, d, "part"), "p_name", "p_type", "p_partkey").select(F.col("p_name").alias("item"), F.col("p_type").alias("group"))


def basket_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").select("l_orderkey").distinct().count()


def bi(expr: str = "p_name", name: str = "bi") -> str:
    return f"{name} AS (SELECT l_orderkey AS basket_id, {expr} AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


PI = "bi AS (SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS item, count(*) AS n FROM lineitem GROUP BY 1, 2)"
BL = "bl AS (SELECT o_orderkey AS basket_id, o_orderpriority AS label FROM orders)"
NL = "bl AS (SELECT o_orderkey AS basket_id, n_name AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
GR = 'gr AS (SELECT p_name AS item, arg_max(p_type, p_partkey) AS "group" FROM part GROUP BY 1)'
SIZES = "s AS (SELECT basket_id, sum(n)::BIGINT AS size, count(*) AS kinds FROM bi GROUP BY 1)"


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p_name, o_orderpriority, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def star_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return B.star_join(table(spark, d, "lineitem"), [(o, "l_orderkey"), (p, "l_partkey")]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "p_name", "o_orderpriority", "l_quantity")


@query("SELECT p_name, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_categories(spark, d):
    return B.top_categories(lines(spark, d), "p_name", 50)


@query("SELECT l_suppkey, " + ", ".join(f"max(CASE WHEN p_type = '{t}' THEN l_quantity END) AS \"{t}\"" for t in TYPES) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def pivot_max(spark, d):
    x = lines(spark, d)
    return B.pivot_max(x, ["l_suppkey"], "p_type", "l_quantity", B.category_values(x, "p_type"))


@query(f"WITH {bi('p_type')} SELECT basket_id, " + ", ".join(f"bool_or(item = '{t}') AS \"{t}\"" for t in TYPES) + " FROM bi GROUP BY 1")
def onehot_items(spark, d):
    return B.onehot_items(items(spark, d, "p_type"), TYPES)


@query(f"WITH {BL} SELECT basket_id, " + ", ".join(f"label = '{p}' AS \"{p}\"" for p in PRIORITIES) + " FROM bl")
def onehot_label(spark, d):
    return B.onehot_label(labels(spark, d), PRIORITIES)


@query("SELECT DISTINCT p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey")
def distinct_items(spark, d):
    return lines(spark, d).select(F.col("p_name").alias("item")).distinct()


@query(f"WITH {BL} SELECT basket_id, coalesce(label, 'unknown') AS label FROM (SELECT DISTINCT l_orderkey AS basket_id FROM lineitem) LEFT JOIN (SELECT * FROM bl WHERE label <> '5-LOW') USING (basket_id)")
def lookup_with_default(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket_id")).distinct()
    return B.with_default(keys, labels(spark, d).where("label <> '5-LOW'"), "basket_id", "label")


@query("SELECT p_name, arg_max(p_type, p_partkey) AS p_type FROM part GROUP BY 1")
def lookup_last_wins(spark, d):
    return B.last_wins(table(spark, d, "part"), "p_name", "p_type", "p_partkey")


@query(f"WITH {bi('p_brand')} SELECT item, sum(n)::BIGINT AS count FROM bi GROUP BY 1 HAVING sum(n) >= {LEAST}")
def item_counts_multiset(spark, d):
    return I.item_counts(items(spark, d, "p_brand"), True, LEAST).select(F.col("items")[0].alias("item"), "count")


@query(f"WITH {bi('p_brand')} SELECT item, count(*) AS count FROM bi GROUP BY 1 HAVING count(*) >= {LEAST}")
def item_counts_set(spark, d):
    return I.item_counts(items(spark, d, "p_brand"), False, LEAST).select(F.col("items")[0].alias("item"), "count")


def joined(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", " + ").alias("itemset"), "count")


PAIRS = "p2 AS (SELECT a.item AS x, b.item AS y, count(*) AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= {least})"
PAIRS_M = "p2 AS (SELECT a.item AS x, b.item AS y, sum(CASE WHEN a.item = b.item THEN a.n * (a.n - 1) ELSE a.n * b.n END)::BIGINT AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item <= b.item GROUP BY 1, 2 HAVING sum(CASE WHEN a.item = b.item THEN a.n * (a.n - 1) ELSE a.n * b.n END) >= {least})"


@query(f"WITH {bi('p_name')}, {PAIRS.format(least=LEAST)} SELECT x || ' + ' || y AS itemset, count FROM p2")
def pairs_set(spark, d):
    return joined(I.pairs_set(items(spark, d), LEAST))


@query(f"WITH {bi('p_name')}, {PAIRS_M.format(least=LEAST)} SELECT x || ' + ' || y AS itemset, count FROM p2")
def pairs_multiset(spark, d):
    return joined(I.pairs_multiset(items(spark, d), LEAST))


@query(f"WITH {bi('p_brand')} SELECT a.item || ' + ' || b.item || ' + ' || c.item AS itemset, count(*) AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item JOIN bi c ON b.basket_id = c.basket_id AND b.item < c.item GROUP BY 1 HAVING count(*) >= {LEAST}")
def triples_set(spark, d):
    return joined(I.mine(items(spark, d, "p_brand"), LEAST, 3).where("k = 3"))


CHOOSE2, CHOOSE3 = "least({0}, 3) * (least({0}, 3) - 1) // 2", "CASE WHEN {0} >= 3 THEN 1 ELSE 0 END"


@query(
    f"""WITH {bi('p_brand')}, {PAIRS_M.format(least=LEAST)}, c3 AS (SELECT a.item AS x, b.item AS y, c.item AS z, sum(CASE
    WHEN a.item = b.item AND b.item = c.item THEN {CHOOSE3.format('a.n')} WHEN a.item = b.item THEN {CHOOSE2.format('a.n')} * least(c.n, 3)
    WHEN b.item = c.item THEN least(a.n, 3) * ({CHOOSE2.format('b.n')}) ELSE least(a.n, 3) * least(b.n, 3) * least(c.n, 3) END)::BIGINT AS count
    FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item <= b.item JOIN bi c ON b.basket_id = c.basket_id AND b.item <= c.item GROUP BY 1, 2, 3)
    SELECT x || ' + ' || y || ' + ' || z AS itemset, count FROM c3 WHERE count >= {LEAST} AND (x, y) IN (SELECT (x, y) FROM p2) AND (x, z) IN (SELECT (x, y) FROM p2) AND (y, z) IN (SELECT (x, y) FROM p2)"""
)
def triples_multiset(spark, d):
    return joined(I.mine(items(spark, d, "p_brand"), LEAST, 3, multiset=True).where("k = 3"))


def _chain(expr: str, k: int) -> str:
    t = [f"t{i}" for i in range(k)]
    on = " ".join(f"JOIN bi {b} ON {a}.basket_id = {b}.basket_id AND {a}.item < {b}.item" for a, b in zip(t, t[1:], strict=False))
    return f"WITH {bi(expr)} SELECT {' || '.join(sum(([x + '.item', chr(39) + ' + ' + chr(39)] for x in t), [])[:-1])} AS itemset, count(*) AS count FROM bi t0 {on} GROUP BY 1 HAVING count(*) >= {LEAST}"


@query(_chain(WORD, 4))
def itemsets_k4(spark, d):
    return joined(I.mine(items(spark, d, WORD), LEAST, 4).where("k = 4"))


@query(_chain("p_type", 5))
def itemsets_k5(spark, d):
    return joined(I.mine(items(spark, d, "p_type"), LEAST, 5).where("k = 5"))


SUPPORT = f"WITH {bi(WORD)}, {PAIRS.format(least=LEAST)}, r AS (SELECT x || ' + ' || y AS itemset, count, row_number() OVER (ORDER BY count DESC, x, y) AS rank, sum(count) OVER (ORDER BY count DESC, x, y) - count AS before, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total FROM p2) "


@query(SUPPORT + "SELECT itemset, count, 'x' || itemset AS name, round(count / total, 6) AS support FROM r")
def itemset_support(spark, d):
    out = I.described(I.pairs_set(items(spark, d, WORD), LEAST), basket_count(spark, d))
    return out.select(F.array_join("items", " + ").alias("itemset"), "count", F.concat(F.lit("x"), "name").alias("name"), F.round("support", 6).alias("support"))


@query(SUPPORT + "SELECT itemset, count FROM r WHERE before < 0.8 * total")
def select_coverage(spark, d):
    return joined(I.select_coverage(I.pairs_set(items(spark, d, WORD), LEAST), basket_count(spark, d), 0.8))


@query(SUPPORT + "SELECT itemset, count FROM r WHERE rank <= 20")
def select_top_support(spark, d):
    return joined(I.select_top_support(I.pairs_set(items(spark, d, WORD), LEAST), 20))


@query(SUPPORT + "SELECT itemset, count, CASE WHEN rank <= 10 THEN 1 ELSE 2 END AS half FROM r WHERE rank <= 20")
def select_balanced(spark, d):
    return I.select_balanced(I.pairs_set(items(spark, d, WORD), LEAST), 20).select(F.array_join("items", " + ").alias("itemset"), "count", "half")


def _words(spark, d):
    """Items for queries that pass over them several times: joined and counted once."""
    x = written(items(spark, d, WORD))
    return B.dealt(x, x.count(), "basket_id")


def _sets(spark, d, x):
    """20 rows, written: so they go to the baskets, not the baskets to them, and are mined once."""
    return written(I.select_top_support(I.pairs_set(x, LEAST), 20).select(F.array_join("items", " + ").alias("itemset"), "items", (F.col("count") / basket_count(spark, d)).alias("support")))


HELD = SUPPORT + ", held AS (SELECT a.basket_id, a.item || ' + ' || b.item AS itemset FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item WHERE a.item || ' + ' || b.item IN (SELECT itemset FROM r WHERE rank <= 20)) "


@query(HELD + "SELECT basket_id, itemset FROM held")
def itemset_containment(spark, d):
    x = _words(spark, d)
    return I.containment(x, _sets(spark, d, x))


@query(f"WITH {bi()}, best AS (SELECT item FROM bi GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 20), f AS (SELECT * FROM bi WHERE item IN (FROM best)) SELECT a.item AS x, b.item AS y, sum(a.n * b.n)::BIGINT AS count FROM f a JOIN f b ON a.basket_id = b.basket_id AND a.item <> b.item GROUP BY 1, 2")
def cooccurrence_topn(spark, d):
    return I.cooccurrence(items(spark, d), 20)


@query(f"WITH {bi()}, {BL}, c AS (SELECT label, a.item || ' + ' || b.item AS combo, a.item AS x, b.item AS y, count(*) AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item JOIN bl ON a.basket_id = bl.basket_id GROUP BY 1, 2, 3, 4) SELECT label, combo, count, row_number() OVER (PARTITION BY label ORDER BY count DESC, x, y) AS rank FROM c QUALIFY rank <= 10")
def top_combos_per_label(spark, d):
    return I.top_combos(items(spark, d), labels(spark, d), 2, 10).select("label", F.array_join("combo", " + ").alias("combo"), "count", "rank")


@query(f"WITH {bi()}, {BL}, {SIZES} SELECT label, size, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY label), 6)::DOUBLE AS pct FROM s JOIN bl USING (basket_id) GROUP BY 1, 2")
def label_size_distribution(spark, d):
    return G.size_distribution(items(spark, d), labels(spark, d)).withColumn("pct", F.round("pct", 6))


@query(
    f"""WITH {bi()}, {BL}, {GR}, {SIZES}, a AS (SELECT label, count(*) AS baskets, sum(size)::BIGINT AS items, round(avg(size), 6) AS avg_size, round(stddev_pop(size), 6) AS std_size FROM s JOIN bl USING (basket_id) GROUP BY 1),
    g AS (SELECT label, "group", sum(n) AS c FROM bi JOIN bl USING (basket_id) JOIN gr USING (item) GROUP BY 1, 2), t AS (SELECT label, "group" AS top_group FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, "group") = 1),
    c AS (SELECT label, item, sum(n) AS c FROM bi JOIN bl USING (basket_id) GROUP BY 1, 2), r AS (SELECT label, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rarity FROM c GROUP BY 1)
    SELECT label, baskets, items, avg_size, std_size, top_group, rarity FROM a JOIN t USING (label) JOIN r USING (label)"""
)
def label_summary(spark, d):
    out = G.summary(items(spark, d), labels(spark, d), groups(spark, d))
    return out.select("label", "baskets", "items", F.round("avg_size", 6).alias("avg_size"), F.round("std_size", 6).alias("std_size"), "top_group", F.round("rarity", 6).alias("rarity"))


@query(f"WITH {bi()}, {BL}, c AS (SELECT label, item, sum(n)::BIGINT AS count FROM bi JOIN bl USING (basket_id) GROUP BY 1, 2), q AS (SELECT label, quantile_cont(count, 0.25) AS lo, quantile_cont(count, 0.75) AS hi FROM c GROUP BY 1) SELECT label, item, count FROM c JOIN q USING (label) WHERE count BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)")
def iqr_filtered_items(spark, d):
    return G.iqr_filtered(items(spark, d), labels(spark, d))


SHARES = f'WITH {bi()}, {BL}, {GR}, g AS (SELECT label, "group", sum(n)::BIGINT AS count FROM bi JOIN bl USING (basket_id) JOIN gr USING (item) GROUP BY 1, 2)'


@query(SHARES + """, f AS (SELECT label, CASE WHEN 100.0 * count / sum(count) OVER (PARTITION BY label) < 15 THEN 'Other' ELSE "group" END AS "group", count FROM g), h AS (SELECT label, "group", sum(count)::BIGINT AS count FROM f GROUP BY 1, 2), p AS (SELECT *, round(100.0 * count / sum(count) OVER (PARTITION BY label), 6)::DOUBLE AS pct FROM h) SELECT label, "group", count, pct, max(pct) OVER (PARTITION BY label) AS largest FROM p""")
def group_share_other(spark, d):
    out = G.group_shares(items(spark, d), labels(spark, d), groups(spark, d), 15.0)
    return out.withColumns({"pct": F.round("pct", 6), "largest": F.round("largest", 6)})


@query(f'WITH {bi()}, {BL}, {GR}, c AS (SELECT label, "group", item, sum(n)::BIGINT AS count FROM bi JOIN bl USING (basket_id) JOIN gr USING (item) GROUP BY 1, 2, 3) SELECT label, "group", item, count, row_number() OVER (PARTITION BY label, "group" ORDER BY count DESC, item) AS rank FROM c QUALIFY rank <= 3')
def group_top_items(spark, d):
    return G.group_top_items(items(spark, d), labels(spark, d), groups(spark, d), 3)


@query(f'WITH {bi()}, {GR}, g AS (SELECT "group", sum(n)::BIGINT AS count FROM bi JOIN gr USING (item) GROUP BY 1), p AS (SELECT "group", count, round(100.0 * count / sum(count) OVER (), 6)::DOUBLE AS pct FROM g) SELECT * FROM p WHERE pct >= 10')
def pie_shares(spark, d):
    return G.pie_shares(items(spark, d), groups(spark, d), 10.0).select("group", "count", F.round("pct", 6).alias("pct"))


PERCENT = f"WITH {bi()}, {BL}, n AS (SELECT label, count(*) AS b FROM bl GROUP BY 1), h AS (SELECT label, item, count(*) AS h FROM bi JOIN bl USING (basket_id) GROUP BY 1, 2), g AS (SELECT label, b, item FROM n, (SELECT DISTINCT item FROM bi)), p AS (SELECT label, item, round(100.0 * coalesce(h, 0) / b, 6)::DOUBLE AS pct FROM g LEFT JOIN h USING (label, item))"


@query(PERCENT + " SELECT label, item, pct FROM p")
def item_pct_by_label(spark, d):
    return G.item_percent(items(spark, d), labels(spark, d)).withColumn("pct", F.round("pct", 6))


@query(PERCENT + " SELECT item, round(sum(pct), 3) AS total FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_items_by_pct(spark, d):
    return G.top_items(G.item_percent(items(spark, d), labels(spark, d)), 10).select("item", F.round("total", 3).alias("total"))


@query(f"WITH {bi()}, {BL}, {SIZES} SELECT label, round(avg(kinds), 6) AS diversity, count(*) AS baskets FROM s JOIN bl USING (basket_id) GROUP BY 1")
def diversity_by_label(spark, d):
    return G.diversity(items(spark, d), labels(spark, d)).withColumn("diversity", F.round("diversity", 6))


BOX = "min(size)::DOUBLE AS min, quantile_cont(size, 0.25)::DOUBLE AS q1, quantile_cont(size, 0.5)::DOUBLE AS median, quantile_cont(size, 0.75)::DOUBLE AS q3, max(size)::DOUBLE AS max, round(avg(size), 6) AS mean, count(*) AS baskets FROM s JOIN bl USING (basket_id)"


@query(f"WITH {bi()}, {BL}, {SIZES} SELECT label, {BOX} GROUP BY 1 UNION ALL SELECT 'all' AS label, {BOX}")
def boxplot_stats(spark, d):
    return G.boxplot(items(spark, d), labels(spark, d)).withColumn("mean", F.round("mean", 6))


@query("WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 15 AS w FROM orders) SELECT least(floor((o_totalprice - lo) / w), 14)::BIGINT AS bin, round(any_value(lo) + least(floor((o_totalprice - lo) / w), 14)::BIGINT * any_value(w), 4) AS lo, count(*) AS count FROM orders, s GROUP BY least(floor((o_totalprice - lo) / w), 14)")
def hist_fixed_bins(spark, d):
    return G.histogram(table(spark, d, "orders"), "o_totalprice", 15).withColumn("lo", F.round("lo", 4))


OVERLAP = f"WITH {PI}, {BL}, f AS (SELECT basket_id, item, label FROM bi JOIN bl USING (basket_id)), z AS (SELECT basket_id, count(*) AS size FROM f GROUP BY 1), o AS (SELECT a.label, a.basket_id AS a, b.basket_id AS b, count(*) AS inter FROM f a JOIN f b ON a.item = b.item AND a.label = b.label AND a.basket_id < b.basket_id GROUP BY 1, 2, 3), m AS (SELECT o.label, inter, x.size AS na, y.size AS nb FROM o JOIN z x ON x.basket_id = a JOIN z y ON y.basket_id = b), t AS (SELECT label, count(DISTINCT basket_id) AS n, (count(DISTINCT basket_id) * (count(DISTINCT basket_id) - 1)) // 2 AS pairs FROM f GROUP BY 1)"


@query(OVERLAP + " SELECT label, any_value(pairs) AS pairs, round(sum(inter / (na + nb - inter)) / any_value(pairs), 9) AS mean FROM m JOIN t USING (label) GROUP BY 1")
def jaccard_mean_by_label(spark, d):
    return S.mean_by_label(part_items(spark, d), labels(spark, d), S.jaccard()).withColumn("mean", F.round("mean", 9))


@query(OVERLAP + " SELECT label, any_value(pairs) AS pairs, round(sum(inter / sqrt(na * nb)) / any_value(pairs), 9) AS mean FROM m JOIN t USING (label) GROUP BY 1")
def cosine_mean_by_label(spark, d):
    return S.mean_cosine_by_label(part_items(spark, d), labels(spark, d), line_count(spark, d)).withColumn("mean", F.round("mean", 9))


@query(OVERLAP + ", h AS (SELECT label, least(floor(inter / (na + nb - inter) * 10 + 1e-9), 9)::BIGINT AS bin, count(*) AS c FROM m GROUP BY 1, 2), u AS (SELECT label, bin, c FROM h UNION ALL SELECT t.label, 0, pairs - coalesce((SELECT sum(c) FROM h WHERE h.label = t.label), 0) FROM t) SELECT label, bin, sum(c)::BIGINT AS count FROM u GROUP BY 1, 2")
def jaccard_hist(spark, d):
    return S.histogram_by_label(part_items(spark, d), labels(spark, d), S.jaccard())


COS = f"WITH {PI}, {NL}, h AS (SELECT label, item, count(DISTINCT basket_id) AS h FROM bi JOIN bl USING (basket_id) GROUP BY 1, 2), nb AS (SELECT label, count(*) AS b FROM bl GROUP BY 1), v AS (SELECT label, item, {{w}} AS w FROM h JOIN nb USING (label)), nr AS (SELECT label, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1), s AS (SELECT x.label AS a, y.label AS b, sum(x.w * y.w) / any_value(p.norm * q.norm) AS sim FROM v x JOIN v y ON x.item = y.item AND x.label < y.label JOIN nr p ON p.label = x.label JOIN nr q ON q.label = y.label GROUP BY 1, 2)"
BINARY, FREQUENCY = COS.format(w="1.0::DOUBLE"), COS.format(w="h / b")


def _sim(spark, d, weight="binary"):
    return S.label_cosine(S.label_vectors(part_items(spark, d), nations(spark, d), weight, line_count(spark, d)))


@query(BINARY + " SELECT a, b, round(sim, 6) AS sim FROM s")
def label_cosine_binary(spark, d):
    return _sim(spark, d).withColumn("sim", F.round("sim", 6))


@query(FREQUENCY + " SELECT a, b, round(sim, 6) AS sim FROM s")
def label_cosine_freq(spark, d):
    return _sim(spark, d, "frequency").withColumn("sim", F.round("sim", 6))


@query(BINARY + " SELECT a, b, CASE WHEN sim >= 0.4 THEN round(sim, 6) END AS sim FROM s")
def label_cosine_masked(spark, d):
    return S.masked(_sim(spark, d)).withColumn("sim", F.round("sim", 6))


@query(BINARY + " SELECT a, b, round(sim, 6) AS sim FROM s ORDER BY round(s.sim, 9) DESC, a, b LIMIT 10")
def label_top_pairs(spark, d):
    return S.top_pairs(_sim(spark, d), 10).withColumn("sim", F.round("sim", 6))


@query(BINARY + ", t AS (SELECT x.a, x.b, y.b AS c, (x.sim + y.sim + z.sim) / 3 AS sim FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b) SELECT a, b, c, round(sim, 6) AS sim FROM t ORDER BY round(t.sim, 9) DESC, a, b, c LIMIT 10")
def label_top_triplets(spark, d):
    return S.top_triplets(_sim(spark, d), 10).withColumn("sim", F.round("sim", 6))


@query(BINARY + ", u AS (SELECT a AS label, b AS other, sim FROM s UNION ALL SELECT b, a, sim FROM s) SELECT label, other, round(sim, 6) AS sim, row_number() OVER (PARTITION BY label ORDER BY round(u.sim, 9) DESC, other) AS rank FROM u QUALIFY rank <= 3")
def label_neighbours(spark, d):
    return S.neighbours(_sim(spark, d)).withColumn("sim", F.round("sim", 6))
