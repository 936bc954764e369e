"""Writers and plain-text reports over small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else c for c, t in df.dtypes])
    flat.write.mode(mode).option("header", True).csv(path)


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def described(df: DataFrame) -> DataFrame:
    """column and type of each column."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def latex_table(df: DataFrame) -> str:
    """A table of a few rows in LaTeX."""
    escape = lambda v: "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    rows = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *df.collect()]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", rows[0], r"\hline", *rows[1:], r"\end{tabular}"]) + "\n"


def html_table(df: DataFrame, title: str) -> str:
    """A page with a table of a few rows."""
    from html import escape

    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "\n".join([row(df.columns, "th"), *[row(r, "td") for r in df.collect()]])
    return f"<!DOCTYPE html>\n<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>\n<table>\n{body}\n</table></body></html>\n"


def label_report(row) -> str:
    """One label's summary as key: value lines."""
    return "\n".join(
        [
            f"Label: {row.label}", f"Total baskets: {row.baskets}", f"Total items: {row['items']}", f"Average items per basket: {row.avg_size:.2f}",
            f"Standard deviation: {row.std_size:.2f}", f"Most common group: {row.top_group}", f"Rarity index: {row.rarity:.2f}",
        ]
    )


def similarity_report(pairs: DataFrame, triplets: DataFrame, near: DataFrame) -> str:
    """Top pairs, top triplets and neighbours, each from tables of at most a few rows a label."""
    lines = ["Top pairs"] + [f"{r.a} - {r.b}: {r.sim:.3f}" for r in pairs.collect()]
    lines += ["", "Top triplets"] + [f"{r.a} - {r.b} - {r.c}: {r.sim:.3f}" for r in triplets.collect()]
    lines += ["", "Neighbours"] + [f"{r.label}: {r.other} ({r.sim:.3f})" for r in near.orderBy("label", "rank").collect()]
    return "\n".join(lines) + "\n"


def strategy_report(stats: DataFrame) -> str:
    rows = stats.orderBy(F.desc("clustering_rate"), "strategy").collect()
    return "\n".join(f"{i}. {r.strategy}: clustering {100 * r.clustering_rate:.1f}%, high confidence {100 * r.high_confidence_rate:.1f}%, average score {r.avg_score:.3f}" for i, r in enumerate(rows, 1)) + "\n"


def cluster_report(clusters: DataFrame) -> str:
    """Numbers of a clustering from its per-cluster table (size, purity)."""
    r = clusters.agg(
        F.count("*").alias("k"), F.sum("size").alias("n"), F.avg("size").alias("mean"), F.median("size").alias("median"), F.max("size").alias("most"), F.min("size").alias("least"),
        (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("weighted"), F.avg("purity").alias("purity"), F.median("purity").alias("purity_median"),
        F.count(F.when(F.col("purity") > 0.5, 1)).alias("high"), F.count(F.when(F.col("purity") < 0.3, 1)).alias("low"),
    ).first()
    return "\n".join(
        [
            f"Clusters: {r.k}", f"Baskets: {r.n}", f"Size mean / median / max / min: {r.mean:.1f} / {r.median:.1f} / {r.most} / {r.least}", f"Size a basket's cluster has on average: {r.weighted:.1f}",
            f"Purity mean / median: {r.purity:.3f} / {r.purity_median:.3f}", f"Purity above 0.5: {r.high}", f"Purity below 0.3: {r.low}",
        ]
    )
