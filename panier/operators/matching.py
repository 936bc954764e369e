"""Entity resolution of names: exact lookup, BM25 retrieval, edit similarity, and four ways to choose between them.

Everything is computed once for each distinct cleaned name and joined back to the occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FUZZY, DATABASE = 0.8, 0.7
#: Words of foods that the database knows better than edit similarity does.
COMMON_FOODS = ["oil", "sauce", "cheese", "milk", "vinegar", "sugar"]
STRATEGIES = ("adaptive", "best_of_both", "db_first", "fuzzy_first")


def distinct_names(names: DataFrame) -> DataFrame:
    return names.select(T.clean(F.col("name")).alias("q")).where("q <> ''").distinct()


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, of docs (doc_id, text); of the terms ``only``, if given."""
    t = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    each = docs.select("doc_id", F.explode(t).alias("term")).where("term <> ''")
    return (each if only is None else each.join(only, "term", "left_semi")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def stemmed(rows: DataFrame, column: str = "term") -> DataFrame:
    """Rows with their terms' stems: each distinct term is stemmed once."""
    from ..functions.stem import stems

    known = rows.select(column).distinct().withColumn("_stem", stems(F.col(column)))
    return rows.join(known, column).drop(column).withColumnRenamed("_stem", column)


def bm25(docs: DataFrame, queries: DataFrame, k: float = 1.2, b: float = 0.0, stop: list[str] | None = None, stem: bool = False) -> DataFrame:
    """q, doc_id, score for queries (q): each query term is joined with its postings.  ``stop``: words that are no terms; ``stem``:
    terms are the words' stems."""
    terms = queries.select("q", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("q"), "[^a-z]+", " "), " "))).alias("term")).where("term <> ''")
    if stop:
        terms = terms.where(~F.col("term").isin(stop))
    if stem or b:
        p = postings(docs)
        if stop:
            p = p.where(~F.col("term").isin(stop))
        if stem:
            terms, p = stemmed(terms).distinct(), stemmed(p).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    else:  # lengths drop out, so no other terms need counting
        p = postings(docs, terms.select("term").distinct())
    n = docs.agg(F.count("*").alias("n"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    length = p.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    mean = length.agg(F.avg("len").alias("avg_len"))
    idf = F.log10((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    x = terms.join(p.join(df, "term"), "term").join(F.broadcast(n))  # one row
    if b:
        x = x.join(length, "doc_id").join(F.broadcast(mean))
        tf = F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avg_len")))
    else:
        tf = F.col("tf") * (k + 1) / (F.col("tf") + k)
    return x.groupBy("q", "doc_id").agg(F.sum(idf * tf).alias("score")).where("score > 0")


#: Terms times queries at most whose weights go to every task.
CELLS = 20_000_000


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    """q, doc_id, score, rank: the k best documents of each query by ``bm25``, ties by doc_id.

    A document's scores for all queries are a row of a product of matrices, and a task keeps the k best of each query: no row a document
    and query is made.  Beyond CELLS weights of terms in queries they are made by joins."""
    import numpy as np
    import pyarrow as pa

    from ..sources.scratch import folder, written

    order = (F.desc(F.round("score", 9)), F.col("doc_id"))
    each = queries.select("q", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("q"), "[^a-z]+", " "), " "))).alias("term")).where("term <> ''").distinct()
    size = each.agg(F.countDistinct("term"), F.countDistinct("q")).first()
    if size[0] * size[1] > (CELLS if cells is None else cells):
        return top(bm25(docs, queries), ["q"], k, *order)
    folder(docs.sparkSession, "bm25")  # executors find this package
    rows = each.toArrow()
    terms, texts = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "q"))
    vocabulary = terms.dictionary
    p = written(postings(docs, F.broadcast(each.select("term").distinct())).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("l")))
    n = docs.count()
    df = dict(map(tuple, p.select(F.explode("l.term").alias("term")).groupBy("term").count().collect()))  # a row a term of the queries
    df = np.array([df.get(t, 0) for t in vocabulary.to_pylist()], float)
    idf = np.log10((n - df + 0.5) / (df + 0.5) + 1)
    m = np.zeros((len(vocabulary), len(texts.dictionary)))
    m[terms.indices.to_numpy(), texts.indices.to_numpy()] = idf[terms.indices.to_numpy()]

    def run(batches):
        best = [(np.empty(0), np.empty(0, np.int64))] * m.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids, l = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                flat, of = l.flatten(), np.repeat(np.arange(len(l)), l.value_lengths().to_numpy(zero_copy_only=False))
                tf = flat.field(1).to_numpy().astype(float)
                w = np.zeros((len(l), len(vocabulary)))
                w[of, pa.compute.index_in(flat.field(0), vocabulary).to_numpy()] = tf * 2.2 / (tf + 1.2)
                scores = w @ m
                least = np.array([s[-1] if len(s) == k else 0.0 for s, _ in best])
                for j in np.flatnonzero((scores > np.maximum(0, least - 2e-9)).any(0)):
                    some = scores[:, j] > max(0.0, least[j] - 2e-9)
                    s, i = np.concatenate([best[j][0], scores[some, j]]), np.concatenate([best[j][1], ids[some]])
                    first = np.lexsort((i, -np.round(s, 9)))[:k]
                    best[j] = s[first], i[first]
        for j, (s, i) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_pydict({"q": pa.array([texts.dictionary[j].as_py()] * len(s)), "doc_id": pa.array(i), "score": pa.array(s)})

    return top(p.where("doc_id IS NOT NULL").mapInArrow(run, "q string, doc_id long, score double"), ["q"], k, *order)


def top(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def bm25_confidence(hits: Column, best: Column) -> Column:
    raw = F.when(hits == 1, 1.0).otherwise(F.greatest(F.lit(0.7), 1 - 0.1 * F.least(F.lit(3), hits)))
    return F.least(raw, best)


def composite(q: Column, c: Column, ratio: Column) -> Column:
    """Edit similarity joined with the words two names share; null below 0.3."""
    a, b = T.word_set(q), T.word_set(c)
    n = F.size(F.array_intersect(a, b))
    r = n / F.greatest(F.size(a), F.size(b))
    base = F.when(n >= 3, 0.6 + 0.1 * r + 0.2 * ratio).when(n == 2, 0.4 + 0.1 * r + 0.3 * ratio).when(n == 1, 0.2 + 0.1 / F.greatest(F.size(a), F.size(b)) + 0.4 * ratio).otherwise(ratio)
    inside, around = F.size(F.array_except(b, a)) == 0, F.size(F.array_except(a, b)) == 0
    bonus = F.when(inside, F.when(F.size(a) == F.size(b), 0.5).otherwise(0.3)).when(around, 0.1).otherwise(0.0)
    return F.when(ratio >= 0.3, F.least(F.lit(1.0), base + bonus))


def fuzzy(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """q, food, score, rank: candidates (food, cleaned) that share a word; the words are joined before any text is compared."""
    qw = queries.select("q", F.explode(T.word_set(F.col("q"))).alias("w"))
    cw = candidates.select("food", "cleaned", F.explode(T.word_set(F.col("cleaned"))).alias("w"))
    pairs = qw.join(cw, "w").select("q", "food", "cleaned").distinct()
    scored = pairs.withColumn("score", F.round(composite(F.col("q"), F.col("cleaned"), T.indel_ratio(F.col("q"), F.col("cleaned"))), 9)).where("score IS NOT NULL")
    return top(scored.select("q", "food", "score"), ["q"], k, F.desc("score"), F.col("food"))


def candidates_of(foods: DataFrame) -> DataFrame:
    return foods.select(F.col("food")).distinct().withColumn("cleaned", T.clean(F.col("food"))).where("cleaned <> ''")


def respelt(queries: DataFrame, known: DataFrame) -> DataFrame:
    """q, c: each name with every word at its commonest known (word, freq) within one edit; names with a word that has none are left out."""
    w = queries.select("q", F.posexplode(F.split("q", " ")).alias("pos", "word")).where("word <> ''")
    best = w.join(corrections(w.select("word"), known), "word", "left").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "best"))).alias("l"), F.count("*").alias("n"), F.count("best").alias("m"))
    return best.where("n = m").select("q", F.array_join(F.transform("l", lambda x: x["best"]), " ").alias("c"))


def searched(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """q, doc_id, score; names that find nothing are searched again as respelt by the words of the documents."""
    found = bm25(docs, queries)
    lost = queries.join(found.select("q").distinct(), "q", "left_anti")
    known = postings(docs).groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("freq"))
    again = respelt(lost, known)
    retried = bm25(docs, again.select(F.col("c").alias("q")).distinct()).withColumnRenamed("q", "c").join(again, "c").select("q", "doc_id", "score")
    return found.unionByName(retried)


def evidence(names: DataFrame, foods: DataFrame, clusters: DataFrame) -> DataFrame:
    """q with ex (exact food), db (food, cluster, score) and fz (food, score); clusters (cluster_id, fdc_id, food_name)."""
    q = distinct_names(names)
    ex = candidates_of(foods).groupBy(F.col("cleaned").alias("q")).agg(F.min("food").alias("ex"))
    point = clusters.groupBy(F.lower("food_name").alias("q")).agg(F.min_by("food_name", F.struct("cluster_id", "food_name")).alias("f"), F.min("cluster_id").alias("c"))
    found = searched(clusters.select(F.col("fdc_id").alias("doc_id"), F.col("food_name").alias("text")), q).join(clusters.select(F.col("fdc_id").alias("doc_id"), "food_name", "cluster_id"), "doc_id")
    five = top(found.withColumn("s", F.round("score", 9)), ["q"], 5, F.desc("s"), F.col("cluster_id"), F.col("doc_id"))
    bm = five.groupBy("q").agg(F.count("*").alias("hits"), F.max("s").alias("best"), F.min_by(F.struct("food_name", "cluster_id"), "rank").alias("d"))
    db = q.join(point, "q", "left").join(bm, "q", "left").select(
        "q", F.coalesce("f", "d.food_name").alias("db_food"), F.coalesce("c", "d.cluster_id").alias("db_cluster"),
        F.when(F.col("f").isNotNull(), 1.0).when(F.col("hits").isNotNull(), bm25_confidence(F.col("hits"), F.col("best"))).otherwise(0.0).alias("db"),
    )
    fz = fuzzy(candidates_of(foods), q).where("rank = 1").select("q", F.col("food").alias("fz_food"), F.col("score").alias("fz"))
    return db.join(ex, "q", "left").join(fz, "q", "left").withColumn("fz", F.coalesce("fz", F.lit(0.0)))


def choose(found: DataFrame, strategy: str) -> DataFrame:
    """q, strategy, matched, cluster_id, score, method, confidence, and other_score, that of the way not taken."""
    db, fz, ex, has_fz = F.col("db"), F.col("fz"), F.col("ex").isNotNull(), F.col("fz_food").isNotNull()
    words = T.word_set(F.col("q"))
    simple = (F.size(words) <= 1) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in COMMON_FOODS]))
    m = F.when(ex, "exact")
    if strategy == "adaptive":
        m = m.when(simple & (db >= DATABASE), "cluster_database").when(fz >= FUZZY, "fuzzy").when((db > 0) & (db >= fz), "cluster_database_fallback").when(has_fz, "fuzzy_fallback")
    elif strategy == "best_of_both":
        m = m.when((db >= fz) & (db >= DATABASE), "cluster_database").when(fz >= FUZZY, "fuzzy").when((db > 0) & (db >= fz), "cluster_database_low_conf").when(has_fz, "fuzzy_low_conf")
    elif strategy == "db_first":
        m = m.when(db >= DATABASE, "cluster_database").when(has_fz, "fuzzy_fallback")
    elif strategy == "fuzzy_first":
        m = m.when(fz >= FUZZY, "fuzzy").when(db > 0, "cluster_database_fallback")
    else:
        raise ValueError(f"no such strategy: {strategy}")
    out = found.withColumn("method", m.otherwise("no_match"))
    by_db, by_fz, exact = F.col("method").startswith("cluster_database"), F.col("method").startswith("fuzzy"), F.col("method") == "exact"
    score = F.when(exact, 1.0).when(by_db, db).when(by_fz, fz).otherwise(0.0)
    return out.select(
        "q", F.lit(strategy).alias("strategy"), F.when(exact, F.col("ex")).when(by_db, F.col("db_food")).when(by_fz, F.col("fz_food")).alias("matched"),
        F.when(by_db, F.col("db_cluster")).otherwise(-1).cast("long").alias("cluster_id"), score.alias("score"), "method",
        F.when(F.col("method").endswith("low_conf"), "low").otherwise(T.confidence(score, exact)).alias("confidence"), F.when(by_db, fz).when(by_fz, db).alias("other_score"),
    )


def match(names: DataFrame, foods: DataFrame, clusters: DataFrame, strategy: str) -> DataFrame:
    return choose(evidence(names, foods, clusters), strategy)


def match_baskets(occurrences: DataFrame, matched: DataFrame) -> DataFrame:
    """Joins results for distinct names back to occurrences (…, name)."""
    return occurrences.withColumn("q", T.clean(F.col("name"))).join(matched, "q", "left")


def statistics(matched: DataFrame) -> DataFrame:
    """Per strategy: results, matched and high-confidence rates, share found in clusters, mean score."""
    rate = lambda c: F.avg(c.cast("double"))
    return matched.groupBy("strategy").agg(
        F.count("*").alias("total"), rate(F.col("method") != "no_match").alias("match_rate"), rate(F.col("cluster_id") >= 0).alias("clustering_rate"),
        rate(F.col("confidence").isin("very_high", "high")).alias("high_confidence_rate"), F.avg("score").alias("avg_score"),
    )


def breakdown(matched: DataFrame, column: str) -> DataFrame:
    n = matched.groupBy("strategy", column).agg(F.count("*").alias("count"))
    return n.withColumn("percentage", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("strategy")))


def best_strategy(stats: DataFrame, metric: str) -> DataFrame:
    return stats.agg(F.min_by("strategy", F.struct(-F.col(metric), F.col("strategy"))).alias("strategy"), F.max(metric).alias(metric))


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, best: the commonest known (word, freq) within one edit, by a join on the texts with up to one letter deleted."""
    drop = lambda c: F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    a = words.select("word").where("word <> ''").distinct().withColumn("key", F.explode(F.array_distinct(drop(F.col("word")))))
    b = known.select(F.col("word").alias("cand"), "freq").where("cand <> ''").withColumn("key", F.explode(F.array_distinct(drop(F.col("cand")))))
    near = a.join(b, "key").select("word", "cand", "freq").distinct()
    # Letters replaced share a deletion, and so do letters swapped; two edits may as well, which the distance tells.
    swap = (F.length("word") == F.length("cand")) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("cand", ""))) & (F.levenshtein("word", "cand") == 2)
    near = near.where((F.levenshtein("word", "cand") <= 1) | swap)
    return near.groupBy("word").agg(F.min_by("cand", F.struct((F.col("cand") != F.col("word")), -F.col("freq"), F.col("cand"))).alias("best"))
