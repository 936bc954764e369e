"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Edge cases, in all stages: a null, empty or very long text and one without white space is a document like any other; a null doc_id is
an id of its own; further columns, whatever their names, stay as they are (a row travels as one struct, beside what the operator
needs); an empty table gives no rows.  Repeated rows stay in all stages but near_duplicates, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panier.llm import common, decontamination, packing, pseudonyms, simhash, toxicity
from panier.llm.queries import tokenizer

SIMILARITY, SHINGLE, WORDS = 0.8, 5, 4


def _packed(docs: DataFrame, *columns) -> DataFrame:
    """The whole row as ``row``, and the given columns of ``docs``."""
    return docs.select(F.struct("*").alias("row"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what operator 5 does not reject (score below 0.7).  A null or blank text has no evidence and stays."""
    labels = common.columns(common.table(spark, sf_dir, "labels"), "doc_id", "toxic")
    rows = _packed(docs, docs["doc_id"], docs["text"])
    return toxicity.scored(rows, labels, ("row",)).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group: five-word shingles, candidates by 256-bit fingerprints, Jaccard similarity 0.8 or more.

    Blank and null texts are one group.  Of rows of one id and text the first stays, in the order of all columns that have one."""
    found = common.written(simhash.similar_documents(docs, SHINGLE, WORDS, SIMILARITY), "similar")
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "th"]
    names = ["none", "id", "th"]
    rows = _packed(docs, docs["doc_id"].cast("long").alias("doc_id"), simhash.text_digest(docs["text"]).alias("th")).select("row", *key)
    kept = rows.join(found.where("NOT keep").select(*key).distinct(), names, "left_anti")
    again = common.written(found.where("keep").groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
    if again.isEmpty():
        return kept.select("row.*")
    order = [F.col("row").getField(f.name) for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # Of each repeated row every task sends one.
    first = kept.join(again, names, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("nth = 1")
    return kept.join(again, names, "left_anti").select("row").unionByName(first.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any window of ten words of a benchmark item.  A null text has no words and stays."""
    found = decontamination.matches(docs, common.table(spark, sf_dir, "benchmark")).where("kind = 'phrase'")
    hits = found.select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct()
    rows = _packed(docs, docs["doc_id"], F.xxhash64(docs["text"]).alias("th"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("h")), "left_anti").select("row.*")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text.  A null text stays null, with no n_chars."""
    rows = pseudonyms.pseudonymised(_packed(docs, docs["text"]))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 4096.  A null text is an empty one: its end id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_near_duplicates), ("decontamination", drop_contaminated), ("pseudonyms", pseudonymise), ("packing", pack)]

#: Fitted models, fingerprints over all pairs and token ids: SQL cannot express them.  tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
