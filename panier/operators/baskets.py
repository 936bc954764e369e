"""The two relations everything else is a query over, and the wide-table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task where a large table is dealt out; tables of up to FEW rows are left to the session's settings.
ROWS, FEW = 100_000, 2_000_000


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Some ``n`` rows dealt by ``keys`` to a task for each ROWS of them, so that tasks become more, not larger, as tables grow."""
    if n is None or n <= FEW:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), *keys)


def normalised(item: Column) -> Column:
    return F.lower(F.trim(item))


def basket_items(lines: DataFrame, basket: str, item: Column, n: int | None = None) -> DataFrame:
    """basket_id, item, n (how often the basket has it); lines without an item are left out.  ``n``: about how many lines there are,
    which are then dealt out by basket."""
    return dealt(lines.select(F.col(basket).alias("basket_id"), item.alias("item")).where("item IS NOT NULL AND item <> ''"), n, "basket_id").groupBy("basket_id", "item").agg(F.count("*").alias("n"))


def from_lists(rows: DataFrame, basket: str, items: str) -> DataFrame:
    """The same from a column of lists."""
    return basket_items(rows.select(basket, F.explode(items).alias("_item_")), basket, normalised(F.col("_item_").cast("string")))


def with_default(keys: DataFrame, values: DataFrame, on: str, column: str, default: str = "unknown") -> DataFrame:
    """Left lookup; keys without a value get the default."""
    return keys.join(values, on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A dictionary built in order: the last row of a key wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Inner equi-joins of a fact table with its dimensions; Spark broadcasts the small ones by their size."""
    for dim, on in dims:
        fact = fact.join(dim, on)
    return fact


def top_categories(rows: DataFrame, category: str, k: int) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("c")).orderBy(F.desc("c"), category).limit(k)


def pivot_max(rows: DataFrame, keys: list[str], category: str, value: str, values: list[str]) -> DataFrame:
    """A column for each of ``values``: the largest value of that category, null where there is none."""
    return rows.groupBy(*keys).pivot(category, values).agg(F.max(value))


def category_values(rows: DataFrame, category: str, k: int = 50) -> list[str]:
    """At most k names, which become columns of a wide table."""
    return sorted(r[0] for r in top_categories(rows, category, k).collect())


def onehot_items(items: DataFrame, values: list[str]) -> DataFrame:
    """basket_id and a boolean column for each item, in one aggregation."""
    return items.groupBy("basket_id").agg(*[F.bool_or(F.col("item") == v).alias(v) for v in values])


def onehot_label(labels: DataFrame, values: list[str]) -> DataFrame:
    return labels.select("basket_id", *[(F.col("label") == v).alias(v) for v in values])
