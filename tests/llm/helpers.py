"""Small tables and brute-force versions for the operator tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside, with values that would break them if they leaked in
CLASHES = ("id", "t", "n", "p", "h", "fp", "key", "k1", "k2", "hits", "label", "shard", "part", "count", "score",
           "pieces", "ids", "th", "first", "mask", "kept", "order", "__own")


def table(spark, rows, clashes=False):
    """Rows (doc_id, text) or (doc_id, text, lang) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clashes else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def unordered(df):
    return sorted(map(tuple, df.collect()), key=repr)
