"""Readers with stated schemas for the file kinds the analyses start from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

FOOD = "fdc_id bigint, description string"
FOOD_NUTRIENT = "fdc_id bigint, nutrient_id bigint, amount double"
NUTRIENT = "id bigint, name string, unit_name string"
RECIPE = "id bigint, cuisine string, ingredients array<string>, title string"
MATCHED = "recipe_id bigint, recipe_title string, cuisine string, original_ingredients array<string>, matched_ingredients array<string>, scores array<double>, methods array<string>, confidences array<string>"
ITEMSETS = "map<string, struct<items: array<string>, count: bigint, support: double, support_percentage: string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, header_schema: str, columns: dict[str, str] | None = None) -> DataFrame:
    """``header_schema`` types the columns by name, whatever their order; ``columns`` renames those that are kept."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    kinds = [c.split() for c in header_schema.split(", ")]
    names = columns or {n: n for n, _ in kinds}
    return raw.select(*[F.expr(f"try_cast(`{n}` AS {k})").alias(names[n]) for n, k in kinds if n in names])


def csv_glob(spark: SparkSession, paths: list[str], column: str = "food") -> DataFrame:
    """The named column of all files that have it, as a bag."""
    out = spark.createDataFrame([], f"{column} string")
    for p in paths:
        one = spark.read.option("header", True).csv(p)
        if column in one.columns:
            out = out.unionByName(one.select(column))
    return out


def row_blocks(rows: DataFrame, order: str, blocks: int) -> DataFrame:
    """Rows with block, from 0: as many blocks as asked, equal but for the last, in ascending ``order`` of a unique column.

    Rows are sorted by ranges; a row's place is its place in its range and the number of rows of the ranges before it."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)).cast("long") - 1))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("c"))
    before = sizes.select("_part", (F.sum("c").over(Window.orderBy("_part")) - F.col("c")).alias("_base"))  # a row a range
    size = -(-ranged.count() // blocks) or 1
    at = (F.col("_base") + F.col("_at")) / F.lit(size)
    return ranged.join(before, "_part").withColumn("block", F.floor(at).cast("long")).drop("_part", "_at", "_base")


def cached(spark: SparkSession, folder: str, name: str, params: dict, compute) -> DataFrame:
    """The table that ``compute`` gave for these parameters: read if it is there, else computed and kept."""
    import hashlib

    key = hashlib.sha256(json.dumps([name, params], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array; without a schema its columns are inferred from it."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_in_zip(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """A JSON array within ZIP archives: each archive is opened on an executor, its records parsed by Spark."""

    def run(frames):
        import io
        import zipfile

        import pandas as pd

        for f in frames:
            records = [json.dumps(x) for blob in f["content"] for x in json.loads(zipfile.ZipFile(io.BytesIO(blob)).read(member))]
            yield pd.DataFrame({"line": records})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def itemset_dictionaries(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The rows of all files that are there; None if none is."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if fs.Path(p).getFileSystem(conf).exists(fs.Path(p))]
    out = None
    for p in there:
        one = itemset_dictionary(spark, p)
        out = one if out is None else out.unionByName(one)
    return out


def itemset_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """An object keyed by display name to rows name, items, count, support."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", ITEMSETS).alias("m"))
    return text.select(F.explode("m").alias("name", "x")).select("name", "x.items", "x.count", "x.support", F.size("x.items").alias("k"))


def zipped_lists(rows: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Parallel lists to one row a place."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(*lists)).alias("pos", "z")).select(*keys, "pos", *[F.col(f"z.{c}").alias(c) for c in lists])
