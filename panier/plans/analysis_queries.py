"""Text, matching, cluster evaluation, vectors and recommendations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as C
from ..operators import evaluation as E
from ..operators import itemsets as I
from ..operators import matching as M
from ..operators import ml
from ..operators import pairs as P
from ..operators import similarity as S
from ..operators.recommend import recommend
from ..sources.readers import table
from ..sources.scratch import written
from .basket_queries import HELD, LEAST, WORD, _sets, _words, bi, items, labels

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STATE = "|".join(T.STATE_WORDS)


def sql_clean(x: str) -> str:
    """The cleaning in DuckDB: words are told by spaces, doubled so that neighbours do not share one."""
    t = rf"lower(regexp_replace(regexp_replace(regexp_replace(replace({x}, '-', ' '), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]', '', 'g'), '\p{{Nd}}+', '', 'g'), '\s+', ' ', 'g'))"
    return rf"trim(regexp_replace(regexp_replace('  ' || replace({t}, ' ', '  ') || '  ', ' ({STATE}) ', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned, length({sql_clean('text')}) AS size FROM documents")
def clean_strings(spark, d):
    c = T.clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("long").alias("size"))


LETTERS = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'), '\s+[a-zA-Z]\s+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(lower({LETTERS}), ' '), lambda w: w <> '')[1:20], ' ') AS tokens FROM documents")
def token_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


def names(spark, d):
    """Names as recipes write them: with marks, state words and other letter case."""
    p = table(spark, d, "part")
    return p.select(F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(", fresh "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(F.col("p_size") % 2 == 0, " oil 2%").otherwise("")).alias("name"))


def foods(spark, d):
    return table(spark, d, "part").where("p_size <= 25 AND p_type <> 'PROMO'").select(F.col("p_name").alias("food")).distinct()


def food_clusters(spark, d):
    p = table(spark, d, "part").where("p_size > 25 AND p_brand < 'Brand#3'")
    return p.groupBy(F.concat_ws(" ", F.reverse(F.split("p_name", " ")), F.lit("oil")).alias("food_name")).agg(F.min("p_partkey").alias("fdc_id"), F.min(F.col("p_size").cast("long")).alias("cluster_id"))


NAMES = "nm AS (SELECT upper(split_part(p_name, ' ', 1)) || ', fresh ' || split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN ' oil 2%' ELSE '' END AS name FROM part)"
Q = f"{NAMES}, q AS (SELECT DISTINCT {sql_clean('name')} AS q FROM nm)"
FOODS = f"fd AS (SELECT DISTINCT p_name AS food, {sql_clean('p_name')} AS cleaned FROM part WHERE p_size <= 25 AND p_type <> 'PROMO')"
FC = "fc AS (SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' oil' AS food_name, min(p_partkey) AS fdc_id, min(p_size)::BIGINT AS cluster_id FROM part WHERE p_size > 25 AND p_brand < 'Brand#3' GROUP BY 1)"


@query(f"WITH {Q}, {FOODS} SELECT q, min(food) AS ex FROM q JOIN fd ON q = cleaned GROUP BY 1")
def exact_match(spark, d):
    ex = M.candidates_of(foods(spark, d)).groupBy(F.col("cleaned").alias("q")).agg(F.min("food").alias("ex"))
    return M.distinct_names(names(spark, d)).join(ex, "q")


def sql_bm25(docs: str, doc_id: str, text: str, q: str = "q") -> str:
    return rf"""pt AS (SELECT {doc_id} AS doc_id, unnest(string_split(regexp_replace(lower({text}), '[^a-z]+', ' ', 'g'), ' ')) AS term FROM {docs}),
    po AS (SELECT doc_id, term, count(*) AS tf FROM pt WHERE term <> '' GROUP BY 1, 2), dq AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    qt AS (SELECT DISTINCT q, unnest(string_split(regexp_replace(lower(q), '[^a-z]+', ' ', 'g'), ' ')) AS term FROM {q}),
    bm AS (SELECT q, doc_id, sum(log10(((SELECT count(*) FROM {docs}) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2)) AS score FROM qt JOIN po USING (term) JOIN dq USING (term) WHERE term <> '' GROUP BY 1, 2)"""


@query(f"WITH bq AS (SELECT DISTINCT text AS q FROM benchmark), {sql_bm25('documents', 'doc_id', 'text', 'bq')}, r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0) SELECT md5(q) AS q, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    found = M.bm25_top(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("text").alias("q")).distinct(), 5)
    return found.select(F.md5("q").alias("q"), "doc_id", F.round("score", 6).alias("score"), "rank")


def sql_ratio(a: str, b: str) -> str:
    cell = f"list_append(acc, CASE WHEN {b}[i] = c THEN prev[i] + 1 ELSE greatest(acc[i], prev[i + 1]) END)"
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, i: {cell}, [0::BIGINT])".replace("range(1,", "range(1,")
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * (list_reduce(string_split({a}, ''), lambda prev, c: {row}, list_resize([0::BIGINT], length({b}) + 1, 0::BIGINT)))[-1] / (length({a}) + length({b})) END"


@query(f"WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON a.x < b.x) SELECT a, b, round({sql_ratio('a', 'b')}, 6)::DOUBLE AS ratio FROM p")
def indel_ratio(spark, d):
    n = E.bounded(table(spark, d, "part").select(F.col("p_name").alias("x")).distinct(), 5000)
    pairs = n.alias("a").join(F.broadcast(n.alias("b")), F.expr("a.x < b.x")).select(F.col("a.x").alias("a"), F.col("b.x").alias("b"))
    return pairs.select("a", "b", F.round(T.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


W = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
FUZZY = f"""wq AS (SELECT q, unnest({W('q')}) AS w FROM q), wc AS (SELECT food, cleaned, unnest({W('cleaned')}) AS w FROM fd), fp AS (SELECT DISTINCT q, food, cleaned FROM wq JOIN wc USING (w)),
    fr AS (SELECT *, {sql_ratio('q', 'cleaned')} AS ratio, len({W('q')}) AS na, len({W('cleaned')}) AS nb, len(list_intersect({W('q')}, {W('cleaned')})) AS n FROM fp),
    fs AS (SELECT q, food, round(least(1.0, CASE WHEN n >= 3 THEN 0.6 + 0.1 * n / greatest(na, nb) + 0.2 * ratio WHEN n = 2 THEN 0.4 + 0.1 * n / greatest(na, nb) + 0.3 * ratio WHEN n = 1 THEN 0.2 + 0.1 / greatest(na, nb) + 0.4 * ratio ELSE ratio END
      + CASE WHEN n = nb THEN CASE WHEN na = nb THEN 0.5 ELSE 0.3 END WHEN n = na THEN 0.1 ELSE 0 END), 9)::DOUBLE AS score FROM fr WHERE ratio >= 0.3),
    fk AS (SELECT q, food, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, food) AS rank FROM fs)"""


@query(f"WITH {Q}, {FOODS}, {FUZZY} SELECT q, food, round(score, 6) AS score, rank FROM fk WHERE rank <= 10")
def fuzzy_topk(spark, d):
    return M.fuzzy(M.candidates_of(foods(spark, d)), M.distinct_names(names(spark, d))).withColumn("score", F.round("score", 6))


EVIDENCE = f"""WITH {Q}, {FOODS}, {FC}, {FUZZY}, {sql_bm25('fc', 'fdc_id', 'food_name')},
    ex AS (SELECT cleaned AS q, min(food) AS ex FROM fd GROUP BY 1), pl AS (SELECT lower(food_name) AS q, arg_min(food_name, (cluster_id, food_name)) AS f, min(cluster_id) AS c FROM fc GROUP BY 1),
    kw AS (SELECT term AS word, sum(tf) AS freq FROM po GROUP BY 1), ms AS (SELECT q FROM q WHERE q NOT IN (SELECT q FROM bm WHERE score > 0)),
    mw AS (SELECT q, unnest(string_split(q, ' ')) AS word, unnest(range(len(string_split(q, ' ')))) AS pos FROM ms),
    fx AS (SELECT m.word, arg_min(k.word, (k.word <> m.word, -freq, k.word)) AS best FROM (SELECT DISTINCT word FROM mw WHERE word <> '') m JOIN kw k ON damerau_levenshtein(m.word, k.word) <= 1 GROUP BY 1),
    cq AS (SELECT q, string_agg(best, ' ' ORDER BY pos) AS c FROM mw LEFT JOIN fx USING (word) WHERE word <> '' GROUP BY 1 HAVING count(*) = count(best)),
    bu AS (SELECT * FROM bm UNION ALL SELECT q, doc_id, sum(log10(((SELECT count(*) FROM fc) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2)) AS score FROM (SELECT DISTINCT q, unnest(string_split(c, ' ')) AS term FROM cq) JOIN po USING (term) JOIN dq USING (term) GROUP BY 1, 2),
    b5 AS (SELECT q, food_name, cluster_id, round(score, 9) AS s, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, cluster_id, bu.doc_id) AS rank FROM bu JOIN fc ON fdc_id = bu.doc_id WHERE score > 0),
    bb AS (SELECT q, count(*) AS hits, max(s) AS best, arg_min(food_name, rank) AS bf, arg_min(cluster_id, rank) AS bc FROM b5 WHERE rank <= 5 GROUP BY 1),
    ev AS (SELECT q, coalesce(f, bf) AS db_food, coalesce(c, bc) AS db_cluster, CASE WHEN f IS NOT NULL THEN 1.0 WHEN hits IS NOT NULL THEN least(CASE WHEN hits = 1 THEN 1.0 ELSE greatest(0.7, 1 - 0.1 * least(3, hits)) END, best) ELSE 0.0 END::DOUBLE AS db,
      ex, food AS fz_food, coalesce(score, 0.0)::DOUBLE AS fz, len({W('q')}) <= 1 OR list_has_any({W('q')}, ['oil', 'sauce', 'cheese', 'milk', 'vinegar', 'sugar']) AS simple
      FROM q LEFT JOIN pl USING (q) LEFT JOIN bb USING (q) LEFT JOIN ex USING (q) LEFT JOIN (SELECT * FROM fk WHERE rank = 1) USING (q))"""
RULES = {
    "adaptive": "WHEN simple AND db >= 0.7 THEN 'cluster_database' WHEN fz >= 0.8 THEN 'fuzzy' WHEN db > 0 AND db >= fz THEN 'cluster_database_fallback' WHEN fz_food IS NOT NULL THEN 'fuzzy_fallback'",
    "best_of_both": "WHEN db >= fz AND db >= 0.7 THEN 'cluster_database' WHEN fz >= 0.8 THEN 'fuzzy' WHEN db > 0 AND db >= fz THEN 'cluster_database_low_conf' WHEN fz_food IS NOT NULL THEN 'fuzzy_low_conf'",
    "db_first": "WHEN db >= 0.7 THEN 'cluster_database' WHEN fz_food IS NOT NULL THEN 'fuzzy_fallback'",
    "fuzzy_first": "WHEN fz >= 0.8 THEN 'fuzzy' WHEN db > 0 THEN 'cluster_database_fallback'",
}


def sql_choice(strategy: str) -> str:
    return f"""SELECT q, '{strategy}' AS strategy, CASE WHEN method = 'exact' THEN ex WHEN method LIKE 'cluster%' THEN db_food WHEN method LIKE 'fuzzy%' THEN fz_food END AS matched,
    CASE WHEN method LIKE 'cluster%' THEN db_cluster ELSE -1 END AS cluster_id, score, method,
    CASE WHEN method LIKE '%low_conf' THEN 'low' WHEN method = 'exact' THEN 'very_high' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'very_low' END AS confidence, CASE WHEN method LIKE 'cluster%' THEN fz WHEN method LIKE 'fuzzy%' THEN db END AS other_score
    FROM (SELECT *, CASE WHEN method = 'exact' THEN 1.0 WHEN method LIKE 'cluster%' THEN db WHEN method LIKE 'fuzzy%' THEN fz ELSE 0.0 END::DOUBLE AS score FROM (SELECT *, CASE WHEN ex IS NOT NULL THEN 'exact' {RULES[strategy]} ELSE 'no_match' END AS method FROM ev))"""


def _evidence(spark, d):
    return M.evidence(names(spark, d), foods(spark, d), food_clusters(spark, d))


def _match(strategy: str):
    def run(spark, d):
        return M.choose(_evidence(spark, d), strategy).withColumns({c: F.round(c, 6) for c in ("score", "other_score")})

    run.__name__ = f"match_{strategy}"
    return query(f"{EVIDENCE} SELECT * REPLACE (round(score, 6) AS score, round(other_score, 6) AS other_score) FROM ({sql_choice(strategy)})")(run)


for _s in M.STRATEGIES:
    _match(_s)

TYPOS = "nm AS (SELECT substr(upper(split_part(p_name, ' ', 1)), 2) || ' ' || split_part(p_name, ' ', 2) || 's' || CASE WHEN p_size % 3 = 0 THEN ' zzzzzz' ELSE '' END AS name FROM part)"


@query(f"{EVIDENCE.replace(NAMES, TYPOS)} SELECT * REPLACE (round(score, 6) AS score, round(other_score, 6) AS other_score) FROM ({sql_choice('best_of_both')})")
def match_spell_retry(spark, d):
    """Names of which no word is known as it stands, some with a word that none is near."""
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    wrong = table(spark, d, "part").select(F.concat(F.substring(F.upper(first), 2, 99), F.lit(" "), second, F.lit("s"), F.when(F.col("p_size") % 3 == 0, " zzzzzz").otherwise("")).alias("name"))
    found = M.evidence(wrong, foods(spark, d), food_clusters(spark, d))
    return M.choose(found, "best_of_both").withColumns({c: F.round(c, 6) for c in ("score", "other_score")})


@query(
    f"{EVIDENCE}, oc AS (SELECT l_orderkey AS basket_id, l_linenumber::BIGINT AS pos, upper(split_part(p_name, ' ', 1)) || ', fresh ' || split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN ' oil 2%' ELSE '' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey), "
    f"ch AS ({sql_choice('adaptive')}) SELECT basket_id, pos, matched, method, round(score, 6) AS score FROM (SELECT *, {sql_clean('name')} AS q FROM oc) LEFT JOIN ch USING (q)"
)
def match_by_basket(spark, d):
    """Results for distinct names, back on every line of every order."""
    p = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(", fresh "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(F.col("p_size") % 2 == 0, " oil 2%").otherwise(""))
    lines = p.select(F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").cast("long").alias("pos"), name.alias("name"))
    return M.match_baskets(lines, M.choose(_evidence(spark, d), "adaptive")).select("basket_id", "pos", "matched", "method", F.round("score", 6).alias("score"))


ALL = f"{EVIDENCE}, al AS ({' UNION ALL '.join(sql_choice(s) for s in M.STRATEGIES)})"


def _all(spark, d):
    ev = written(_evidence(spark, d))
    out = M.choose(ev, M.STRATEGIES[0])
    for s in M.STRATEGIES[1:]:
        out = out.unionByName(M.choose(ev, s))
    return out


@query(f"{ALL} SELECT strategy, count(*) AS total, round(avg((method <> 'no_match')::INT), 6) AS match_rate, round(avg((cluster_id >= 0)::INT), 6) AS clustering_rate, round(avg((confidence IN ('very_high', 'high'))::INT), 6) AS high_confidence_rate, round(avg(score), 6) AS avg_score FROM al GROUP BY 1")
def match_stats(spark, d):
    s = M.statistics(_all(spark, d))
    return s.select("strategy", "total", *[F.round(c, 6).alias(c) for c in ("match_rate", "clustering_rate", "high_confidence_rate", "avg_score")])


@query(f"{ALL} SELECT strategy, method, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY strategy), 6)::DOUBLE AS percentage FROM al GROUP BY 1, 2")
def match_methods(spark, d):
    return M.breakdown(_all(spark, d), "method").withColumn("percentage", F.round("percentage", 6))


@query(f"{ALL} SELECT strategy, confidence, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY strategy), 6)::DOUBLE AS percentage FROM al GROUP BY 1, 2")
def match_confidences(spark, d):
    return M.breakdown(_all(spark, d), "confidence").withColumn("percentage", F.round("percentage", 6))


@query(f"{ALL}, st AS (SELECT strategy, avg((cluster_id >= 0)::INT) AS r FROM al GROUP BY 1) SELECT strategy, round(r, 6) AS clustering_rate FROM st ORDER BY r DESC, strategy LIMIT 1")
def match_best(spark, d):
    return M.best_strategy(M.statistics(_all(spark, d)), "clustering_rate").withColumn("clustering_rate", F.round("clustering_rate", 6))


def segments(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_mktsegment").alias("label"))


CT = "ct AS (SELECT c_nationkey AS cluster, c_mktsegment AS label, count(*) AS c FROM customer GROUP BY 1, 2)"


@query(f"WITH {CT} SELECT cluster, sum(c)::BIGINT AS size, arg_min(label, (-c, label)) AS dominant, round(max(c) / sum(c), 6)::DOUBLE AS purity FROM ct GROUP BY 1")
def cluster_purity(spark, d):
    return E.per_cluster(segments(spark, d)).select("cluster", "size", "dominant", F.round("purity", 6).alias("purity"))


@query(f"WITH {CT}, p AS (SELECT cluster, c / sum(c) OVER (PARTITION BY cluster) AS p FROM ct) SELECT cluster, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def cluster_entropy(spark, d):
    return E.per_cluster(segments(spark, d)).select("cluster", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {CT} SELECT cluster, label, c, round(c / sum(c) OVER (PARTITION BY cluster), 6)::DOUBLE AS share FROM ct")
def confusion_norm(spark, d):
    return E.confusion(segments(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {CT}, s AS (SELECT sum(c * (c - 1) / 2.0) AS s, sum(c)::DOUBLE AS n FROM ct), a AS (SELECT sum(x * (x - 1) / 2.0)::DOUBLE AS a FROM (SELECT sum(c) AS x FROM ct GROUP BY cluster)), b AS (SELECT sum(x * (x - 1) / 2.0)::DOUBLE AS b FROM (SELECT sum(c) AS x FROM ct GROUP BY label)) SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9)::DOUBLE AS ari FROM s, a, b")
def ari(spark, d):
    return E.ari(segments(spark, d)).select(F.round("ari", 9).alias("ari"))


@query(f"WITH {CT}, n AS (SELECT sum(c)::DOUBLE AS n FROM ct), a AS (SELECT cluster, sum(c)::DOUBLE AS x FROM ct GROUP BY 1), b AS (SELECT label, sum(c)::DOUBLE AS y FROM ct GROUP BY 1) SELECT round((SELECT sum(c / n * ln(c * n / (x * y))) FROM ct JOIN a USING (cluster) JOIN b USING (label), n) / (((SELECT -sum(x / n * ln(x / n)) FROM a, n) + (SELECT -sum(y / n * ln(y / n)) FROM b, n)) / 2), 9) AS nmi")
def nmi(spark, d):
    return E.nmi(segments(spark, d)).select(F.round("nmi", 9).alias("nmi"))


@query(f"WITH {CT}, p AS (SELECT cluster, sum(c) AS size, max(c) / sum(c) AS purity FROM ct GROUP BY 1) SELECT count(*) AS clusters, round(avg(size), 6) AS per_cluster, round((sum(size * size) / sum(size))::DOUBLE, 6) AS per_row, round(avg(purity), 6) AS mean_purity, round(median(purity), 6) AS median_purity FROM p")
def cluster_size_averages(spark, d):
    p = E.per_cluster(segments(spark, d))
    return p.agg(F.count("*").alias("clusters"), F.round(F.avg("size"), 6).alias("per_cluster"), F.round(F.sum(F.col("size") * F.col("size")) / F.sum("size"), 6).alias("per_row"), F.round(F.avg("purity"), 6).alias("mean_purity"), F.round(F.median("purity"), 6).alias("median_purity"))


@query(f"WITH {CT} SELECT cluster, label, c FROM ct WHERE c >= 10")
def cluster_flows(spark, d):
    return E.contingency(segments(spark, d)).where("c >= 10")


@query("SELECT o_orderpriority AS label, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS basket_id FROM orders GROUP BY 1")
def latest_per_label(spark, d):
    order = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.max_by("o_orderkey", order).alias("basket_id"))


@query(HELD + ", bl AS (SELECT o_orderkey AS basket_id, o_orderpriority AS label FROM orders), c AS (SELECT itemset, label, count(*) AS c FROM held JOIN bl USING (basket_id) GROUP BY 1, 2), p AS (SELECT itemset, c / sum(c) OVER (PARTITION BY itemset) AS p, sum(c) OVER (PARTITION BY itemset) AS n FROM c), h AS (SELECT itemset, any_value(n) AS n, -sum(p * log2(p)) AS h FROM p GROUP BY 1) SELECT itemset, round(count / total, 6) AS support, round(1 - h / log2(5), 6) AS disc, round(0.7 * (1 - h / log2(5)) + 0.3 * count / total, 6) AS score FROM h JOIN r USING (itemset) WHERE n >= 5 AND count / total BETWEEN 0.02 AND 0.6")
def discrimination_score(spark, d):
    x = _words(spark, d)
    sets = _sets(spark, d, x)
    out = E.discrimination(I.containment(x, sets), labels(spark, d), sets)
    return out.select("itemset", *[F.round(c, 6).alias(c) for c in ("support", "disc", "score")])


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


V = "vx AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"
EUCLID, COSINE = "list_distance(x.v, y.v)", "1 - list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"


def sql_both(dist: str) -> str:
    return f"{V}, bw AS (SELECT x.id AS a, x.cluster AS ca, y.id AS b, y.cluster AS cb, {dist} AS d FROM vx x JOIN vx y ON x.id <> y.id)"


SIL = "by_ AS (SELECT a, ca, cb, avg(d) AS m FROM bw GROUP BY 1, 2, 3), si AS (SELECT a, max(CASE WHEN ca = cb THEN m END) AS x, min(CASE WHEN ca <> cb THEN m END) AS y FROM by_ GROUP BY 1)"
SILHOUETTE = "SELECT round(avg(CASE WHEN x IS NULL OR y IS NULL OR greatest(x, y) = 0 THEN 0 ELSE (y - x) / greatest(x, y) END), 6) AS silhouette, count(*) AS points FROM si"


@query(f"WITH {sql_both(COSINE)}, {SIL} {SILHOUETTE}")
def silhouette_cosine(spark, d):
    return E.silhouette(E.mean_cosine_distances(vectors(spark, d))).select(F.round("silhouette", 6).alias("silhouette"), "points")


@query(f"WITH {sql_both(COSINE)}, {SIL} SELECT round(avg((least(y, 1.0) - coalesce(x, 0)) / greatest(least(y, 1.0), coalesce(x, 0))), 6) AS silhouette FROM si")
def silhouette_capped(spark, d):
    return E.silhouette_capped(E.mean_cosine_distances(vectors(spark, d))).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {sql_both(EUCLID)}, m AS (SELECT avg(CASE WHEN ca = cb THEN d END) AS intra, avg(CASE WHEN ca <> cb THEN d END) AS inter FROM bw) SELECT round(intra, 6) AS intra, round(inter, 6) AS inter, round(inter / intra, 6) AS ratio FROM m")
def intra_inter(spark, d):
    out = E.separation(P.mean_distances(vectors(spark, d), S.euclid))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


SUPPLIERS = "su AS (SELECT DISTINCT l_suppkey AS id, p_brand || '/' || p_size AS item FROM lineitem JOIN part ON l_partkey = p_partkey), vs AS (SELECT id, list(item) AS v FROM su GROUP BY 1), vx AS (SELECT id, n_regionkey AS cluster, v FROM vs JOIN supplier ON id = s_suppkey JOIN nation ON s_nationkey = n_nationkey), bw AS (SELECT x.id AS a, x.cluster AS ca, y.id AS b, y.cluster AS cb, 1 - len(list_intersect(x.v, y.v)) / (len(x.v) + len(y.v) - len(list_intersect(x.v, y.v))) AS d FROM vx x JOIN vx y ON x.id <> y.id)"


@query(f"WITH {SUPPLIERS}, {SIL} {SILHOUETTE}")
def silhouette_jaccard(spark, d):
    b = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.concat_ws("/", "p_brand", "p_size")).alias("v"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("cluster"))

    return E.silhouette(P.mean_distances(written(b.join(s, "id")), S.jaccard_distance)).select(F.round("silhouette", 6).alias("silhouette"), "points")


LONG = f"{V}, lg AS (SELECT id, cluster, unnest(range(0, 64)) AS j, unnest(v) AS x FROM vx)"


@query(f"WITH {LONG}, g AS (SELECT j, avg(x) AS g FROM lg GROUP BY 1), c AS (SELECT cluster, j, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM lg GROUP BY 1, 2), t AS (SELECT sum(n * (m - g) ^ 2) AS b, sum(w) AS w, count(DISTINCT cluster) AS k FROM c JOIN g USING (j)) SELECT round((b / (k - 1)) / (w / ((SELECT count(*) FROM vx) - k)), 6) AS ch FROM t")
def calinski_harabasz(spark, d):
    return E.calinski_harabasz(vectors(spark, d)).select(F.round("ch", 6).alias("ch"))


SMALL = f"WITH {sql_both(EUCLID)}, sz AS (SELECT cluster, count(*) AS size FROM vx GROUP BY 1), lm AS (SELECT (SELECT count(*) FROM vx) // 10 AS least), ds AS (SELECT bw.* FROM bw JOIN sz p ON p.cluster = ca JOIN sz q ON q.cluster = cb, lm WHERE p.size < least AND q.size >= least)"
SMALL_SQL = {
    "remove": "SELECT id, CASE WHEN size < least THEN -1 ELSE cluster END AS cluster FROM vx JOIN sz USING (cluster), lm",
    "outlier_class": "SELECT id, CASE WHEN size < least THEN (SELECT max(cluster) + 1 FROM vx) ELSE cluster END AS cluster FROM vx JOIN sz USING (cluster), lm",
    "merge_nearest": ", av AS (SELECT ca, cb, avg(d) AS m FROM ds GROUP BY 1, 2), tt AS (SELECT ca AS cluster, arg_min(cb, (round(m, 9), cb)) AS t FROM av GROUP BY 1) SELECT id, coalesce(t, cluster) AS cluster FROM vx LEFT JOIN tt USING (cluster)",
    "reassign": ", tt AS (SELECT a AS id, arg_min(cb, (round(d, 9), cb)) AS t FROM ds GROUP BY 1) SELECT id, coalesce(t, cluster) AS cluster FROM vx LEFT JOIN tt USING (id)",
}


def _small(how: str):
    def run(spark, d):
        v = vectors(spark, d)
        return C.small_clusters(v, v.count() // 10, how, S.euclid)

    run.__name__ = f"small_cluster_{how}"
    return query(f"{SMALL} {SMALL_SQL[how]}")(run)


for _h in SMALL_SQL:
    _small(_h)


@query(f"WITH {V} SELECT cluster, count(*) AS size, count(*) >= 50 AS valid FROM vx GROUP BY 1")
def cluster_sizes_valid(spark, d):
    return C.sizes_valid(vectors(spark, d), 50)


QUOTAS = "WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT label, n, greatest(1, 503 * n // (SELECT count(*) FROM orders)) AS q FROM n), g AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS r, 503 - sum(q) OVER () AS gap FROM q) SELECT label, n, (q + CASE WHEN gap > 0 AND r <= gap THEN 1 WHEN gap < 0 AND r <= -gap AND q > 1 THEN -1 ELSE 0 END)::BIGINT AS quota FROM g"


@query(QUOTAS)
def sample_quotas(spark, d):
    return C.quotas(labels(spark, d), 503)


@query(f"WITH quotas AS ({QUOTAS}) SELECT basket_id, label FROM (SELECT o_orderkey AS basket_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-42'), o_orderkey) AS r FROM orders) JOIN quotas USING (label) WHERE r <= quota")
def stratified_sample(spark, d):
    return C.stratified(labels(spark, d), 503)


@query(HELD + ", cl AS (SELECT o_orderkey AS basket_id, o_orderstatus AS cluster FROM orders), m AS (SELECT cluster, itemset, count(*) AS c FROM held JOIN cl USING (basket_id) GROUP BY 1, 2), z AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), f AS (SELECT cluster, itemset, c / n AS mean, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, itemset) AS rank, max((c / n > 0.1)::INT) OVER (PARTITION BY cluster) AS anyhit FROM m JOIN z USING (cluster)) SELECT cluster, itemset, round(mean, 6) AS mean, rank FROM f WHERE (anyhit = 1 AND mean > 0.1) OR (anyhit = 0 AND rank <= 5)")
def cluster_profile(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderstatus").alias("cluster"))
    x = _words(spark, d)
    return C.profile(I.containment(x, _sets(spark, d, x)), c).withColumn("mean", F.round("mean", 6))


@query(f"WITH {LONG}, s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM lg GROUP BY 1) SELECT id, j, round(CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END, 6) AS z FROM lg JOIN s USING (j)")
def standardize(spark, d):
    return ml.standardised(vectors(spark, d)).withColumn("z", F.round("z", 6))


@query(f"WITH {LONG}, s AS (SELECT cluster, j, var_pop(x) AS v FROM lg GROUP BY 1, 2) SELECT cluster, round(sum(v), 6) AS variance FROM s GROUP BY 1")
def variance_sum(spark, d):
    return ml.variance_sum(vectors(spark, d), ["cluster"]).withColumn("variance", F.round("variance", 6))


@query("WITH tk AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), tv AS (SELECT token, embedding::DOUBLE[] AS v FROM (SELECT token, row_number() OVER (ORDER BY token) - 1 AS vec_id FROM tk) JOIN embeddings USING (vec_id)), x AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part), y AS (SELECT id, unnest(range(0, 64)) AS j, unnest(v) AS x FROM x JOIN tv USING (token)), z AS (SELECT id, j, sum(x) / 20 AS x FROM y GROUP BY 1, 2) SELECT id, round(max(x), 6) AS most, round(sum(x), 6) AS total FROM z GROUP BY 1")
def token_vector_mean(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))
    # A row for each word that names are made of.
    rank = p.select(F.explode("tokens").alias("token")).distinct().select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("vec_id"))
    v = rank.join(table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), "vec_id").select("token", "v")
    return ml.token_mean(p, v).select("id", F.round(F.array_max("v"), 6).alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {LONG}, c AS (SELECT cluster, j, avg(x) AS m FROM lg GROUP BY 1, 2), dd AS (SELECT x.cluster AS a, y.cluster AS b, sqrt(sum((x.m - y.m) ^ 2)) AS d FROM c x JOIN c y USING (j) GROUP BY 1, 2) SELECT a, b, round(d, 6) AS d FROM dd WHERE a < b AND d <= (SELECT quantile_cont(d, 0.3) FROM dd)")
def centroid_pairs(spark, d):
    return ml.centroid_pairs(vectors(spark, d), 0.3).withColumn("d", F.round("d", 6))


@query("WITH w AS (SELECT split_part(p_name, ' ', 2) AS word, count(*) AS freq FROM part GROUP BY 1), x AS (SELECT word[2:] AS q FROM w UNION SELECT word FROM w UNION SELECT word || 's' FROM w), p AS (SELECT q, word, freq FROM x JOIN w ON levenshtein(q, word) <= 1) SELECT q AS word, arg_min(word, (word <> q, -freq, word)) AS best FROM p GROUP BY 1")
def spell_correction(spark, d):
    w = table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).agg(F.count("*").alias("freq"))
    x = w.select(F.expr("substring(word, 2)").alias("word")).union(w.select("word")).union(w.select(F.concat("word", F.lit("s"))))
    return M.corrections(x, w)


QUERY_ITEMS = ["blue", "cold", "old"]


@query(
    HELD
    + ", cl AS (SELECT o_orderkey AS basket_id, o_orderstatus AS cluster FROM orders), qs AS (SELECT itemset FROM r WHERE rank <= 20 AND itemset IN ('blue + cold', 'blue + old', 'cold + old')), e AS (SELECT cluster, basket_id, count(itemset) AS nb, count(CASE WHEN itemset IN (FROM qs) THEN 1 END) AS i, (SELECT count(*) FROM qs) AS nq FROM cl LEFT JOIN held USING (basket_id) GROUP BY 1, 2), m AS (SELECT cluster, avg(CASE WHEN nb + nq - i > 0 THEN i / (nb + nq - i) ELSE 0 END) AS m FROM e GROUP BY 1), best AS (SELECT arg_min(cluster, (-round(m, 9), cluster)) AS cluster FROM m), o AS (SELECT cluster, basket_id, count(item) AS overlap FROM cl JOIN best USING (cluster) LEFT JOIN (SELECT * FROM bi WHERE item IN ('blue', 'cold', 'old')) USING (basket_id) GROUP BY 1, 2) SELECT * FROM o WHERE overlap = (SELECT max(overlap) FROM o)"
)
def recommend_baskets(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderstatus").alias("cluster"))
    x = _words(spark, d)
    sets = _sets(spark, d, x)
    return recommend(QUERY_ITEMS, x, I.containment(x, sets), sets, c)


@query()
def pca_reduce(spark, d):
    return ml.pca(vectors(spark, d), 16)


@query()
def kmeans_fit(spark, d):
    return ml.kmeans(vectors(spark, d).select("id", "v"), 10).select("id", "cluster")


@query()
def bisecting_variance(spark, d):
    v = vectors(spark, d).select("id", "v")
    total = ml.variance_sum(v.withColumn("one", F.lit(1)), ["one"]).first().variance
    return ml.bisecting(v, 0.8 * total, 8)


@query()
def agglomerative_avg(spark, d):
    """Merges of the average linkage over the vectors; a row a merge, by height."""
    import pyarrow as pa

    h, x, y = P.average_merges(vectors(spark, d), S.euclid)
    tree = C.ordered(zip(h.tolist(), x.tolist(), y.tolist(), strict=True), len(h) + 1)
    left, right, size = (tree[:, i].astype("int64") for i in (0, 1, 3))
    table = pa.table({"step": pa.array(range(len(tree)), pa.int64()), "left": left, "right": right, "height": tree[:, 2], "size": size})
    return spark.createDataFrame(table, "step long, left long, right long, height double, size long")


@query()
def recursive_kmeans(spark, d):
    v = vectors(spark, d).withColumn("label", F.col("cluster").cast("string")).select("id", "label", "v")
    return ml.recursive_kmeans(v, 4, 20, depth=2)


@query()
def mlp_label(spark, d):
    return ml.mlp(vectors(spark, d).withColumn("label", F.col("cluster").cast("string")).select("id", "label", "v"))


@query(f"WITH {bi(WORD)} SELECT item, count(*) AS count FROM bi GROUP BY 1 HAVING count(*) >= {LEAST}")
def mined_level1(spark, d):
    return I.mine(items(spark, d, WORD), LEAST, 1).select(F.col("items")[0].alias("item"), "count")


