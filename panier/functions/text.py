"""Cleaning, tokens and edit similarity of names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that describe the state of an ingredient and not the ingredient.
STATE_WORDS = [
    "aged", "frozen", "fresh", "organic", "chopped", "ground", "cubed", "sliced", "cooked",
    "roasted", "dried", "fried", "fully", "flavored", "unflavored", "grated", "cold", "powdered", "plain",
]


def clean(text: Column, state_words: list[str] | None = None) -> Column:
    """Lower case, no marks, digits or state words, single spaces; ``beaten`` goes where there are eggs.  Null gives ''."""
    words = STATE_WORDS if state_words is None else state_words
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(F.replace(t, F.lit("-"), F.lit(" ")), r"(?U)[^\w\s]", "")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, r"(?U)\d+", ""), r"(?U)\s+", " "))
    t = F.when(t.contains("egg"), F.regexp_replace(t, r"(?U)\bbeaten\b", "")).otherwise(t)
    if words:
        t = F.regexp_replace(t, r"(?U)\b(?:" + "|".join(words) + r")\b", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_letters(text: Column) -> Column:
    """ASCII letters only, lone letters between spaces dropped, single spaces."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+[a-zA-Z]\s+", " "), r"\s+", " "))


def tokens(text: Column, most: int = 20) -> Column:
    return F.slice(F.filter(F.split(F.lower(clean_letters(text)), " "), lambda w: w != ""), 1, most)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (|a| + |b|), 1 for two empty texts: a row of the usual table is folded over the other text's characters."""
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    zeros = F.transform(F.concat(F.array(F.lit(0)), F.transform(y, lambda c: F.lit(0))), lambda v: v)

    def row(prev, c):
        def cell(acc, i):
            left, up, diag = F.element_at(acc, -1), F.element_at(prev, i + 1), F.element_at(prev, i)
            return F.concat(acc, F.array(F.when(F.element_at(y, i) == c, diag + 1).otherwise(F.greatest(left, up))))

        return F.when(F.size(y) == 0, prev).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(y), F.lit(1))), F.array(F.lit(0)), cell))

    lcs = F.element_at(F.aggregate(x, zeros, row), -1)
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * lcs / n)


def zero_filled(x: Column) -> Column:
    """0 where a number is null or not a number."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def confidence(score: Column, exact: Column) -> Column:
    return F.when(exact, "very_high").when(score >= 0.9, "high").when(score >= 0.7, "medium").when(score >= 0.5, "low").otherwise("very_low")


def register(spark: SparkSession) -> None:
    """SQL functions indel_ratio(a, b) is too deep for SQL text; clean_name(text) is registered for SQL use."""
    words = "|".join(STATE_WORDS)
    spark.sql(
        rf"""CREATE OR REPLACE TEMPORARY FUNCTION clean_name(x STRING) RETURNS STRING RETURN
        trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(x, ''), '-', ' '),
        '(?U)[^\\w\\s]', ''), '(?U)\\d+', ''), '(?U)\\s+', ' ')), '(?U)\\b(?:{words})\\b', ''), '(?U)\\s+', ' '))"""
    )
