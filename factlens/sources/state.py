"""The table of document states: one row per change, the latest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states that a document goes through.
STATUSES = ["uploaded", "queued", "parsing", "chunking", "extracting", "embedding", "graphing", "indexed", "failed"]


def latest(states: DataFrame) -> DataFrame:
    """The last row of each document, newest documents first."""
    last = states.groupBy("id").agg(F.max_by(F.struct(*states.columns), F.struct("updated_at", "progress")).alias("s")).select("s.*")
    return last.orderBy(F.desc("created_at"), "id")


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the fields of new that aren't null laid over it, by id."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns]
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(*cols)


def remove(states: DataFrame, id_: str) -> DataFrame:
    return states.where(F.col("id") != id_)


def synced(records: DataFrame, known: DataFrame) -> DataFrame:
    """records with what is known of each; those of which nothing is known have failed."""
    mark = known.select("id").withColumn("_known", F.lit(True))
    out = overlay(records, known.join(records.select("id"), "id", "left_semi")).join(mark, "id", "left")
    gone = F.col("_known").isNull()
    return out.withColumn("status", F.when(gone, "failed").otherwise(F.col("status"))).withColumn("error", F.when(gone, F.coalesce("error", F.lit("unknown to the store"))).otherwise(F.col("error"))).drop("_known")
