"""Level-wise frequent itemsets over sets and multisets, and their selection.

Candidates of a level are made from the level below and pruned by it before any basket is looked at; the itemsets that a basket holds grow
by one item a level, and only candidates are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .baskets import dealt


def item_counts(items: DataFrame, multiset: bool, least: int) -> DataFrame:
    """items (one), k, count: baskets with the item, or its occurrences."""
    c = F.sum("n") if multiset else F.count("*")
    return items.groupBy("item").agg(c.alias("count")).where(F.col("count") >= least).select(F.array("item").alias("items"), F.lit(1).alias("k"), "count")


def _small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table for a join: to every task if it has few rows, however many files it has."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _frequent(items: DataFrame, level1: DataFrame) -> DataFrame:
    return items.join(level1.select(F.col("items")[0].alias("item")), "item", "left_semi")


def pairs_set(items: DataFrame, least: int) -> DataFrame:
    """Baskets that hold both of two frequent items: a self-join on the basket with map-side counts."""
    f = _frequent(items, _small(written(item_counts(items, False, least)))).select("basket_id", "item")
    both = f.alias("a").join(f.alias("b"), "basket_id").where("a.item < b.item")
    return both.groupBy(F.col("a.item").alias("x"), F.col("b.item").alias("y")).agg(F.count("*").alias("count")).where(F.col("count") >= least).select(F.array("x", "y").alias("items"), F.lit(2).alias("k"), "count")


def pairs_multiset(items: DataFrame, least: int, dedupe_self_pairs: bool = False) -> DataFrame:
    """Products of multiplicities; a pair of one item with itself counts n (n - 1), or half of that with ``dedupe_self_pairs``."""
    f = _frequent(items, _small(written(item_counts(items, True, least))))
    both = f.alias("a").join(f.alias("b"), "basket_id").where("a.item <= b.item")
    same = F.col("a.n") * (F.col("a.n") - 1)
    c = F.when(F.col("a.item") == F.col("b.item"), F.floor(same / 2) if dedupe_self_pairs else same).otherwise(F.col("a.n") * F.col("b.n")).cast("long")
    return both.groupBy(F.col("a.item").alias("x"), F.col("b.item").alias("y")).agg(F.sum(c).alias("count")).where(F.col("count") >= least).select(F.array("x", "y").alias("items"), F.lit(2).alias("k"), "count")


def first_level(items: DataFrame, level1: DataFrame) -> DataFrame:
    """basket_id, items (one), ns: where each frequent item occurs, and how often."""
    return _frequent(items, level1).select("basket_id", F.array("item").alias("items"), F.array("n").alias("ns"))


def _grown(held: DataFrame, frequent: DataFrame, multiset: bool) -> DataFrame:
    """Itemsets that baskets hold, each with one more of the basket's items put before its first."""
    first = F.col("items")[0]
    before = F.col("item") < first
    if multiset:
        before = before | ((F.col("item") == first) & (F.col("n") > F.size(F.filter("items", lambda x: x == first))))
    both = held.join(frequent.select("basket_id", "item", "n"), "basket_id").where(before)
    return both.select("basket_id", F.concat(F.array("item"), "items").alias("items"), F.concat(F.array("n"), "ns").alias("ns"))


def candidates(below: DataFrame, k: int, multiset: bool) -> DataFrame:
    """items: sorted sets of size k whose subsets without one of their first three places are all in the level below."""
    rest = F.slice("items", 2, k - 2)
    a, b = below.select("items", rest.alias("rest")), below.select(F.col("items")[0].alias("item"), rest.alias("rest"))
    ordered = F.col("item") <= F.col("items")[0] if multiset else F.col("item") < F.col("items")[0]
    made = a.join(b, "rest").where(ordered).select(F.concat(F.array("item"), "items").alias("items"))
    if k > 2:
        made = made.withColumn("rest", F.concat(F.slice("items", 1, 2), F.slice("items", 4, k))).join(below.select(F.col("items").alias("rest")), "rest", "left_semi").select("items")
    return made


def occurrences(k: int, most: int | None = -1) -> Column:
    """In how many ways a basket with ``ns`` of each of ``items`` (sorted, k of them) holds them, an item counting ``most`` times at most
    (k times if not given; None: all)."""
    if most is None:
        # The r-th of equal items has n - r + 1 to choose from, and r orders.
        place = F.sequence(F.lit(1), F.lit(k))

        def choice(w, i):
            r = F.size(F.filter(F.slice("items", F.lit(1), i), lambda y: y == F.element_at("items", i)))
            return w * (F.element_at("ns", i) - r + 1) / r

        return F.aggregate(place, F.lit(1.0), choice).cast("long")
    factorial = [1]
    for i in range(1, k + 1):
        factorial.append(factorial[-1] * i)
    table = F.array(*[F.lit(x).cast("long") for x in factorial])
    times = lambda x: F.size(F.filter("items", lambda y: y == x))

    def ways(w, x):
        n, m = F.least(F.element_at("ns", F.array_position("items", x).cast("int")), F.lit(k)).cast("int"), times(x)
        return (w * table[n] / (table[m] * table[n - m])).cast("long")

    return F.aggregate(F.array_distinct("items"), F.lit(1).cast("long"), ways)


def counted(made: DataFrame, k: int, multiset: bool, least: int) -> DataFrame:
    """items, k, count of what baskets hold."""
    count = F.sum(occurrences(k)) if multiset else F.count("*")
    return made.groupBy("items").agg(count.alias("count")).where(F.col("count") >= least).select("items", F.lit(k).alias("k"), "count")


def mine(items: DataFrame, least: int, most: int = 5, multiset: bool = False) -> DataFrame:
    """All levels up to ``most``; stops when one is empty.  Each level, and where its itemsets occur, is a written table, as the next is
    built on it; of the last level only the counts are kept."""
    items = written(items)
    items = dealt(items, items.count(), "basket_id")
    level1 = written(item_counts(items, multiset, least))
    levels, frequent, made = [level1], _frequent(items, _small(level1)), first_level(items, _small(level1))
    for k in range(2, most + 1):
        if k == 2:  # pairs are counted without being kept
            level, made = (pairs_multiset if multiset else pairs_set)(items, least), _grown(made, frequent, multiset)
        else:
            wanted = _small(written(candidates(levels[-1], k, multiset)))
            made = _grown(made.join(_small(levels[-1]).select("items"), "items", "left_semi"), frequent, multiset).join(wanted, "items", "left_semi")
            if k < most:
                made = written(made)
            level = counted(made, k, multiset, least)
        level = written(level)
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def described(found: DataFrame, baskets: int) -> DataFrame:
    """Adds name, support and support_percentage; repeated items of a multiset are written once with their number."""
    names = F.transform(F.array_distinct("items"), lambda x: F.concat(x, F.when(F.size(F.filter("items", lambda y: y == x)) > 1, F.format_string(" (×%d)", F.size(F.filter("items", lambda y: y == x)))).otherwise("")))
    support = F.col("count") / F.lit(baskets)
    return found.withColumns({"name": F.array_join(names, " + "), "support": support, "support_percentage": F.format_string("%.2f%%", support * 100)})




def select_coverage(found: DataFrame, baskets: int, share: float) -> DataFrame:
    """The strongest itemsets up to and with the one by which their supports sum to ``share``."""
    w = Window.orderBy(F.desc("count"), "items").rowsBetween(Window.unboundedPreceding, -1)
    # Itemsets found are far fewer than baskets; one ordered pass over them.
    return found.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).where(F.col("before") < F.lit(share * baskets)).drop("before")


def select_top_support(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("count"), "items").limit(k)


def select_balanced(found: DataFrame, k: int) -> DataFrame:
    """The k // 2 strongest and the next k - k // 2: the same rows as by support, with their half told."""
    w = Window.orderBy(F.desc("count"), "items")
    return select_top_support(found, k).withColumn("half", F.when(F.row_number().over(w) <= k // 2, 1).otherwise(2))


def union_of_sizes(lists: list[DataFrame]) -> DataFrame:
    """Lists of itemsets (items, k, count) one after another; of those with the same items, in any order, the first stays."""
    each = reduce(DataFrame.unionByName, [x.select("items", "k", "count", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    w = Window.partitionBy(F.array_sort("items")).orderBy("list", F.desc("count"), "items")
    return each.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def sparsity(contained: DataFrame, baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """baskets, itemsets, ones and the share of zeros of the binary matrix of baskets and itemsets."""
    n = lambda df, c: df.agg(F.countDistinct(c).alias(c + "s"))
    t = n(baskets, "basket_id").join(n(sets, "itemset")).join(contained.select("basket_id", "itemset").distinct().agg(F.count("*").alias("ones")))
    return t.select(F.col("basket_ids").alias("baskets"), "itemsets", "ones", (1 - F.col("ones") / (F.col("basket_ids").cast("double") * F.col("itemsets"))).alias("sparsity"))


def containment(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(basket_id, itemset) for each itemset a basket holds whole; ``sets`` (itemset, items).  Join on the item, count, compare."""
    wanted = sets.select("itemset", F.size("items").alias("size"), F.explode("items").alias("item"))
    return items.select("basket_id", "item").distinct().join(wanted, "item").groupBy("basket_id", "itemset", "size").agg(F.count("*").alias("c")).where("c = size").select("basket_id", "itemset")


def cooccurrence(items: DataFrame, top: int) -> DataFrame:
    """Symmetric counts of positions of the ``top`` commonest items in common baskets."""
    best = items.groupBy("item").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "item").limit(top)
    f = items.join(F.broadcast(best.select("item")), "item", "left_semi")
    both = f.alias("a").join(f.alias("b"), "basket_id").where("a.item < b.item").groupBy(F.col("a.item").alias("x"), F.col("b.item").alias("y")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("count"))
    return both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "count"))


def top_combos(items: DataFrame, labels: DataFrame, size: int, k: int, repeats: bool = False) -> DataFrame:
    """label, combo, count, rank: the k commonest combinations of two or three items in each label's baskets.  With ``repeats`` every
    occurrence of an item counts, so a combination may hold an item as often as the basket does."""
    f = items.select("basket_id", "item", "n").join(labels, "basket_id")
    out = f.select("label", "basket_id", F.array("item").alias("items"), F.array("n").alias("ns"))
    for _ in range(size - 1):
        last = F.element_at("items", -1)
        more = F.col("item") > last
        if repeats:
            more = more | ((F.col("item") == last) & (F.col("n") > F.size(F.filter("items", lambda x: x == last))))
        out = out.join(f.select("basket_id", "item", "n"), "basket_id").where(more).select("label", "basket_id", F.concat("items", F.array("item")).alias("items"), F.concat("ns", F.array("n")).alias("ns"))
    w = Window.partitionBy("label").orderBy(F.desc("count"), "combo")
    count = F.sum(occurrences(size, None)) if repeats else F.count("*")
    return out.groupBy("label", F.col("items").alias("combo")).agg(count.alias("count")).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
