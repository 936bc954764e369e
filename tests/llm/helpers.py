"""Small documents with nulls, ties, copies, odd white space and clashing column names."""

TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and then it rests near the old barn."),
    (1, "The quick brown fox jumps over the lazy dog and then it rests near the old barn."),
    (2, None),
    (3, ""),
    (4, "one"),
    (5, "Äpfel  und\tBirnen\n\nsind ÉTÉ Straße’s 中文 字 ́x."),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (7, "word " * 3000),
    (None, "a row without an id but with some words in it"),
    (9, "tie"),
    (9, "tie"),
    (9, "another text of the same id"),
    (10, "special <|endoftext|> and <|startoftext|> tokens"),
]


def docs(spark, rows=TEXTS):
    """doc_id, text and further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 AS n", "'x' AS word", "2.0 AS score", "'p' AS part", "0 AS pos", "'z' AS kind", "'k' AS key", "1 AS item")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def plain(df):
    return df.select("doc_id", "text")
