"""Set-similarity join: all pairs of different token sets whose Jaccard likeness is above a threshold.

Two sets of l and m tokens whose likeness is above t share at least need(l, m) of them. With all tokens in one order, the rarest
first, such sets have one in common among the first l - need + 1 of the one and the first m - need + 1 of the other. So each set
sends, for each size that a partner may have, a row for each of these few rare tokens, and rows meet by token and both sizes.
A frequent token is sent only where sets are so small that it has to count, and sets of sizes that can't be alike never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.text import canonical_name, search_tokens

LIKENESS = 0.4


def token_sets(names: DataFrame, name_col: str = "name") -> DataFrame:
    """name, key, tokens: a name's tokens (those of search_tokens) in order, and joined by spaces as a key; names without tokens are
    left out."""
    tokens = F.sort_array(search_tokens(canonical_name(name_col)))
    return names.select(F.col(name_col).alias("name"), tokens.alias("tokens")).where(F.size("tokens") > 0).select("name", F.array_join("tokens", " ").alias("key"), "tokens")


def _need(l: Column, m: Column, t: float) -> Column:
    """The fewest tokens that sets of two sizes share if their likeness is above t."""
    # Above, not at: a whole bound takes one more. The margin is for rounding; what it lets in is verified.
    return F.floor((l + m) * (t / (1 + t)) - 1e-9).cast("int") + 1


def similar_sets(sets: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Pairs a_key below b_key of different sets (key, tokens; a key may come again) with their likeness, above `least` (from 0 to below
    1). Each pair comes once, whatever number of names has the sets."""
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    own = sets.select("key", "tokens").where("key IS NOT NULL AND size(tokens) > 0").dropDuplicates(["key"])
    listed = own.select("key", F.size("tokens").alias("l"), F.explode("tokens").alias("token"))
    counts = listed.groupBy("token").agg(F.count("*").alias("c"))
    ranked = listed.join(counts, "token").groupBy("key", "l").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("tokens"))
    # Partners' sizes: the smaller set has more than `least` of the larger one's.
    sizes = F.sequence(F.floor(F.col("l") * least).cast("int") + 1, F.greatest(F.ceil(F.col("l") / least).cast("int") - 1, F.floor(F.col("l") * least).cast("int") + 1))
    rows = ranked.withColumn("m", F.explode(sizes))
    prefix = F.slice("tokens", 1, F.greatest(F.lit(0), F.col("l") - _need(F.col("l"), F.col("m"), least) + 1))
    sent = rows.withColumn("token", F.explode(prefix))
    a = sent.select("token", F.col("l").alias("la"), F.col("m").alias("lb"), F.col("key").alias("a_key"), F.col("tokens").alias("a"))
    b = sent.select("token", F.col("m").alias("la"), F.col("l").alias("lb"), F.col("key").alias("b_key"), F.col("tokens").alias("b"))
    met = a.join(b, ["token", "la", "lb"]).where("a_key < b_key")
    shared = F.array_intersect("a", "b")
    # A pair that shares several of these tokens is taken at the first one that it shares in the common order.
    first = F.get(F.filter("a", lambda x: F.array_contains("b", x)), F.lit(0))
    alike = F.size(shared) / (F.col("la") + F.col("lb") - F.size(shared))
    return met.where(F.col("token") == first).select("a_key", "b_key", alike.alias("likeness")).where(F.col("likeness") > least)
