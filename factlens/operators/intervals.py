"""Operators over tables of intervals: overlap join, sweep, snapshot and context differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import interval as iv

KEY_CHARS = 80


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, *, days: int = 0, bound: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of rows whose intervals overlap.

    Without `days` this is the plain condition, which Spark runs as a nested loop over a broadcast side: right for a
    small side. With `days`, both sides are dealt into buckets of so many days, joined by bucket, and a pair is kept in
    the later of their first buckets only, so large sides with short intervals shuffle and no pair comes twice. Open
    ends reach to `bound`, by default the first and last day of both sides, so that they have no more buckets than the
    data have.
    """
    exact = iv.overlaps(ls, le, rs, re)
    if not days:
        return left.join(right, exact)
    if bound is None:
        ends = left.select(F.explode(F.array(ls, le)).alias("d")).unionByName(right.select(F.explode(F.array(rs, re)).alias("d")))
        got = ends.agg(F.min("d").alias("low"), F.max("d").alias("high")).first()
        bound = (str(got["low"] or "1970-01-01"), str(got["high"] or "1970-01-01"))

    def dealt(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        number = lambda x: F.floor(F.datediff(x, F.to_date(F.lit(bound[0]))) / days)
        first = number(F.greatest(F.coalesce(F.col(s), F.to_date(F.lit(bound[0]))), F.to_date(F.lit(bound[0]))))
        last = number(F.least(F.coalesce(F.col(e), F.to_date(F.lit(bound[1]))), F.to_date(F.lit(bound[1]))))
        return df.withColumn(f"_{name}_first", first).withColumn("_bucket", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array(first))))

    a, b = dealt(left, ls, le, "l"), dealt(right, rs, re, "r")
    pairs = a.join(b, "_bucket").where(exact & (F.col("_bucket") == F.greatest("_l_first", "_r_first")))
    return pairs.drop("_bucket", "_l_first", "_r_first")


def sweep(df: DataFrame, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Segments (segment_start, segment_end, active) between neighbouring dates with at least one active interval.

    Starts add one and ends take one away on their own day; open ends add no event, and the last segment is not closed.
    The events are summed by day before the running sum, so one task sees days, not rows. What gives the rows runs once.
    """
    events = df.select(F.inline(F.array(*[F.struct(F.col(c).alias("d"), F.lit(n).alias("n")) for c, n in ((start, 1), (end, -1))])))
    by_day = events.where("d IS NOT NULL").groupBy("d").agg(F.sum("n").alias("n"))
    order = Window.orderBy("d")
    out = by_day.select(F.col("d").alias("segment_start"), F.lead("d").over(order).alias("segment_end"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("active"))
    return out.where("active > 0 AND segment_end IS NOT NULL")


def _side(edges: DataFrame, window: tuple, first: bool, cut: int | None, extra: list[str], order: str) -> DataFrame:
    key = [(F.substring(c, 1, cut) if cut else F.col(c)).alias(c) for c in ("subject", "predicate", "object")]
    rows = edges.where(iv.valid_within("valid_from", "valid_until", *window)).select(*key, F.struct(*extra).alias("v"), F.col(order).alias("_seq"))
    pick = F.min_by if first else F.max_by
    return rows.groupBy("subject", "predicate", "object").agg(pick("v", "_seq").alias("v"))


def _difference(a: DataFrame, b: DataFrame, same) -> DataFrame:
    key = ["subject", "predicate", "object"]
    both = a.withColumnRenamed("v", "before").join(b.withColumnRenamed("v", "after"), key, "full_outer")
    bucket = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(bucket.alias("bucket"), *key, "before", "after")


def snapshot_diff(a: DataFrame, b: DataFrame, window_a: tuple, window_b: tuple, order: str = "edge_seq") -> DataFrame:
    """Facts added, removed, changed or unchanged between two windows: bucket, subject, predicate, object, before, after.

    Facts are told apart by their parts cut to 80 characters, the first of equals counts, and evidence is compared too.
    """
    extra = ["valid_from", "valid_until", "evidence"]
    sides = [_side(x, w, True, KEY_CHARS, extra, order) for x, w in ((a, window_a), (b, window_b))]
    same = F.lit(True)
    for c in extra:
        same = same & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    return _difference(*sides, same)


def context_diff(a: DataFrame, b: DataFrame, order: str = "edge_seq") -> DataFrame:
    """The same for two answers' facts: whole parts tell facts apart, the last before and each after counts (the last of
    equals), and only validity decides about a change."""
    extra = ["valid_from", "valid_until"]
    sides = [_side(x, (None, None), False, None, extra, order) for x in (a, b)]
    same = F.col("before.valid_from").eqNullSafe(F.col("after.valid_from")) & F.col("before.valid_until").eqNullSafe(F.col("after.valid_until"))
    return _difference(*sides, same)
