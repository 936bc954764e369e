"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Postings (document, position, term) of the benchmark's vocabulary are stored for all documents.
2. Each window of ten item words takes its two rarest terms by the stored counts as anchors.
3. The anchors' posting lists, each offset by the anchor's place in the item, are intersected: a document and alignment in which both
   anchors of some window stand is a candidate.
4. Candidates are compared with the item word by word along the alignment; every window that agrees is an exact phrase match, and an
   alignment where none does although anchors met is a proximity match.

``proximity`` instead takes anchors that stand a stated number of words nearer or farther than in the item.

An alignment costs one row however many windows it has, and a hot passage one row per document and alignment.

Edge cases: a null or empty text has no words; a text of any length is indexed whole; an item of fewer than ten words is one window, of none is none; repeated items and
documents are matched each; two rows of one doc_id are told apart by their texts, equal rows have equal results; an empty benchmark
or table gives no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SIZE = 10
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything below the digits, between digits and letters, and after the letters, within ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items up to this many words are sent to every task; a larger benchmark is joined by shuffles.
BROADCAST_WORDS = 200_000


def words(text: str) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def item_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (row number), item_id, words; items without words are left out.  Equal (id, text) rows are one item."""
    rows = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[text_col].alias("text")).distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words("text").alias("w")).where("size(w) > 0")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def index(docs: DataFrame, items: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Terms (term, t) of the items and postings (doc_id, th, pos, t) of all ``docs`` (doc_id, th, text)."""
    terms = common.written(items.select(F.explode("w").alias("term")).distinct().withColumn("t", F.xxhash64("term")), "terms")
    each = docs.select("doc_id", "th", F.posexplode(words("text")).alias("pos", "term"))
    if small:
        posts = each.join(F.broadcast(terms), "term")
    else:  # the commonest words meet in no one task
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        posts = each.withColumn("salt", F.pmod("pos", F.lit(SALTS))).join(salted, ["term", "salt"])
    posts = posts.select("doc_id", "th", "pos", "t")
    return terms, common.written(posts, "postings")


def anchors(items: DataFrame, terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, place, t) of the anchors, and (item, p, q) pairs of places of which a window has both."""
    freq = postings.groupBy("t").agg(F.count("*").alias("f"))
    ranked = items.select("item", F.posexplode("w").alias("place", "term")).join(terms, "term").join(freq, "t", "left")
    row = F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("place"), F.col("t"))
    lists = ranked.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", row.alias("r")))).alias("l"))  # as long as the item
    starts = F.sequence(F.lit(0), F.greatest(F.size("l") - SIZE, F.lit(0)))
    windows = lists.select("item", F.explode(F.transform(starts, lambda i: F.array_sort(F.transform(F.slice("l", i + 1, SIZE), lambda x: x["r"])))).alias("s"))
    first, second = F.col("s")[0], F.when(F.size("s") > 1, F.col("s")[1]).otherwise(F.col("s")[0])
    pairs = windows.select("item", first.alias("a"), second.alias("b")).distinct()
    places = pairs.select("item", "a.place", "a.t").union(pairs.select("item", "b.place", "b.t")).distinct()
    return places, pairs.select("item", F.col("a.place").alias("p"), F.col("b.place").alias("q")).distinct()


def candidates(postings: DataFrame, places: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """(doc_id, th, item, diag): alignments in which both anchors of a window stand at their offsets."""
    met = postings.join(_small(places, small), "t").select("doc_id", "th", "item", (F.col("pos") - F.col("place")).alias("diag"), "place")
    by = met.groupBy("doc_id", "th", "item", "diag").agg(F.collect_set("place").alias("places"))  # as many as the item's words
    wanted = pairs.groupBy("item").agg(F.collect_list(F.struct("p", "q")).alias("pq"))
    both = F.exists("pq", lambda x: F.array_contains("places", x["p"]) & F.array_contains("places", x["q"]))
    return by.join(_small(wanted, small), "item").where(both).select("doc_id", "th", "item", "diag")


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, item_id, distance: documents in which the two rarest words of some window of an item stand in their order with up to
    ``slack`` words more or fewer between them than in the item; the least such difference.

    Their lists are intersected as those of phrases are, but by ranges of slack + 1 alignments, of which two neighbours are looked at."""
    items = common.written(item_words(benchmark), "items")
    small = (items.agg(F.sum(F.size("w"))).first()[0] or 0) <= BROADCAST_WORDS
    terms, postings = index(keyed(docs, id_col, text_col), items, small)
    places, pairs = anchors(items, terms, postings)
    met = common.written(postings.join(_small(places, small), "t").select("doc_id", "th", "item", "place", F.col("pos").alias("x"), (F.col("pos") - F.col("place")).alias("diag")), "met")
    ordered = pairs.select("item", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    width = slack + 1
    first = met.join(_small(ordered, small), ["item"]).where("place = p").select("doc_id", "th", "item", "q", "x", "diag", F.explode(F.array(*[F.floor(F.col("diag") / width) + i for i in (-1, 0, 1)])).alias("range"))
    second = met.select(F.col("doc_id").alias("d2"), F.col("th").alias("h2"), F.col("item").alias("item2"), F.col("place").alias("q2"), F.col("x").alias("x2"), F.col("diag").alias("diag2"), F.floor(F.col("diag") / width).alias("range2"))
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("th").eqNullSafe(F.col("h2")) & F.expr("item = item2 AND q = q2 AND range = range2")
    both = first.join(second, same).where((F.abs(F.col("diag2") - F.col("diag")) <= slack) & ((F.col("x2") > F.col("x")) | (F.col("q") == 0)))
    return both.groupBy("doc_id", "th", "item").agg(F.min(F.abs(F.col("diag2") - F.col("diag"))).cast("int").alias("distance")).join(_small(items.select("item", "item_id"), small), "item").drop("item")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, item and alignment: kind ('phrase' or 'proximity') and, for phrases, the starts (0-based word positions
    in the document) of the windows that agree, and their length."""
    items = common.written(item_words(benchmark), "items")
    small = (items.agg(F.sum(F.size("w"))).first()[0] or 0) <= BROADCAST_WORDS
    rows = keyed(docs, id_col, text_col)
    terms, postings = index(rows, items, small)
    places, pairs = anchors(items, terms, postings)
    places, pairs = common.written(places, "anchors"), common.written(pairs, "anchor-pairs")
    found = candidates(postings, places, pairs, small).groupBy("doc_id", "th", "item").agg(F.collect_list("diag").alias("diags"))  # no more than the document's words
    found = common.written(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item", "diags")).alias("c")), "candidates")
    # Texts of candidates only, one of equal rows; the join's side is a small part of the table and Spark measures it at run time.
    texts = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["th"] == found["th"])).select(rows["doc_id"], rows["th"], "text", "c")
    texts = texts.select("doc_id", "th", words("text").alias("d"), "c")
    # All alignments of a document with an item are compared in one row, which holds the words of both once.
    one = texts.select("doc_id", "th", "d", F.explode("c").alias("c")).select("doc_id", "th", "d", "c.item", "c.diags").join(_small(items.select("item", "item_id", "w"), small), "item")
    one = one.withColumn("length", F.least(F.size("w"), F.lit(SIZE)))
    windows, n = F.sequence(F.lit(0), F.size("w") - F.col("length")), F.col("length")

    def starts(diag):
        agree = F.filter(windows, lambda i: (i + diag >= 0) & (F.slice("d", F.greatest(i + diag, F.lit(0)) + 1, n) == F.slice("w", i + 1, n)))
        return F.struct(diag.alias("diag"), F.transform(agree, lambda i: (i + diag).cast("int")).alias("s"))

    out = one.select("doc_id", "th", "item", "item_id", "length", F.explode(F.transform("diags", starts)).alias("x")).select("doc_id", "th", "item", "item_id", "length", "x.*")
    return out.select("doc_id", "th", "item", "item_id", "diag", F.when(F.size("s") > 0, "phrase").otherwise("proximity").alias("kind"), F.col("s").alias("starts"), "length")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and th, the text's hash."""
    found = matches(docs, benchmark, id_col, text_col).where("kind = 'phrase'")
    # A start and a length in one number: sets of numbers are hashed, sets of structs would be compared in pairs.
    spots = F.flatten(F.collect_list(F.transform("starts", lambda s: s.cast("long") * 16 + F.col("length"))))
    per = found.groupBy("doc_id", "th").agg(F.array_distinct(spots).alias("spots"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda x: F.sequence(F.shiftright(x, 4), F.shiftright(x, 4) + x % 16 - 1)))))  # at most the document's words
    per = common.written(per.select(F.col("doc_id").alias("d2"), F.col("th").alias("th2"), covered.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256")), "hits")
    rows = keyed(docs, id_col, text_col)
    n_words = F.size(words("text")).cast("long")
    counted = rows.select("doc_id", "th", n_words.alias("n_words"))
    out = counted.join(per, counted["doc_id"].eqNullSafe(per["d2"]) & counted["th"].eqNullSafe(per["th2"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "th",
    )
