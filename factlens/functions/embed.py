"""Feature-hashing embeddings: sparse (bucket, value) rows for joins, dense vectors for output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.text import word_tokens

DIMENSIONS = 768
#: Embedders by name: functions of (df, id columns, text column, dimensions) that return ids and `vector`.
EMBEDDERS: dict[str, Callable] = {}


def bucket(word: Column, dimensions: int = DIMENSIONS) -> Column:
    """The md5 of a word as a 128-bit number modulo the dimensions (below 2 ** 31), folded by 32 bits at a time."""
    out = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(F.md5(word), 8 * i + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit(1 << 32) + part, F.lit(dimensions).cast("long"))
    return out.cast("int")


def term_frequencies(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """ids, term, tf."""
    return df.select(*ids, F.explode(word_tokens(text)).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("tf"))


def sparse_embedding(df: DataFrame, ids: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """ids, bucket, value: one plus the logarithm of each word's frequency, added up by bucket, to length 1."""
    # Texts are dealt by their ids once; a text's words, buckets and norm are counted where it is.
    terms = term_frequencies(df.select(*ids, text).repartition(*ids), ids, text).withColumn("bucket", bucket(F.col("term"), dimensions))
    values = terms.groupBy(*ids, "bucket").agg(F.sum(1 + F.log("tf")).alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*ids)))
    return values.select(*ids, "bucket", (F.col("value") / norm).alias("value"))


def dense_embedding(df: DataFrame, ids: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """ids, vector (array of floats; all zeros for texts without words), within each row: no shuffle."""
    words = word_tokens(text)
    terms = F.transform(F.array_distinct(F.col("_w")), lambda w: F.struct(bucket(w, dimensions).alias("b"), (1 + F.log(F.size(F.filter("_w", lambda x: x == w)))).alias("v")))
    value = lambda b: F.aggregate(F.filter("_t", lambda x: x["b"] == b), F.lit(0.0), lambda s, x: s + x["v"])
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value)
    rows = df.select(*ids, words.alias("_w")).withColumn("_t", terms).select(*ids, raw.alias("_r"))
    norm = F.sqrt(F.aggregate("_r", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_n", norm).select(*ids, F.transform("_r", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0).cast("float")).alias("vector"))


EMBEDDERS["hashing"] = dense_embedding


def embed(df: DataFrame, ids: list[str], text: str = "text", dimensions: int = DIMENSIONS, provider: str = "hashing") -> DataFrame:
    """By a registered embedder; an unknown name raises KeyError."""
    return EMBEDDERS[provider](df, ids, text, dimensions)


def squared_distance(a, b) -> Column:
    """Squared Euclidean distance of two vectors, added up in double precision."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
