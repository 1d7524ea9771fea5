"""As-of join: for each probe the latest version of its subject's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_latest(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, tie: str, *, name: str = "fact", days: int = 30) -> DataFrame:
    """probes with the fact (a struct of the fact's columns; null if there is none) of the same key whose time is the latest at or
    before the probe's; of facts of the same time the one with the greatest `tie`. Null keys and times meet nothing.

    Probes and facts of a key are put in order of time and the last fact is carried on. A key's time is cut into slices of so many
    days, which are put in order one by one, so a key with a third of all rows is many tasks' work; between the slices of a key go
    only their last facts, one a slice.
    """
    slice_ = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    own = facts.where(F.col(key).isNotNull() & F.col(fact_time).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(fact_time).alias("_t"))
    latest = own.agg(F.max_by(F.struct(*[c for c in facts.columns if c != key]), tie).alias("_v")).withColumn("_slice", slice_("_t"))
    asked = probes.select(F.col(key).alias("_k"), F.col(probe_time).alias("_t"), F.struct(*[c for c in probes.columns if c != key]).alias("_p"), slice_(probe_time).alias("_slice"))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType)
    rows = latest.select("_k", "_t", "_slice", "_v", none("_p", asked).alias("_p"), F.lit(0).alias("_kind")).unionByName(asked.where("_k IS NOT NULL AND _t IS NOT NULL").select("_k", "_t", "_slice", none("_v", latest).alias("_v"), "_p", F.lit(1).alias("_kind")))
    within = Window.partitionBy("_k", "_slice").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).where("_kind = 1").select("_k", "_slice", "_p", "_own")
    # A slice begins with the last fact of the slices before it.
    ends = latest.groupBy("_k", "_slice").agg(F.max_by("_v", "_t").alias("_last"))
    ends = ends.unionByName(asked.select("_k", "_slice", none("_last", ends).alias("_last")).where("_k IS NOT NULL AND _slice IS NOT NULL").distinct())
    ends = ends.groupBy("_k", "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = held.join(carried, ["_k", "_slice"]).select("_k", "_p", F.coalesce("_own", "_carried").alias("_v"))
    lost = asked.where("_k IS NULL OR _t IS NULL").select("_k", "_p", none("_v", latest).alias("_v"))
    # The key isn't carried along in the structs.
    fact = F.when(F.col("_v").isNotNull(), F.struct(*[F.col("_k").alias(c) if c == key else F.col(f"_v.{c}").alias(c) for c in facts.columns]))
    return out.unionByName(lost).select(*[F.col("_k").alias(c) if c == key else F.col(f"_p.{c}").alias(c) for c in probes.columns], fact.alias(name))
