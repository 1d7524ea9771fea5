"""Queries over stored tables of facts, overlap by dyadic nodes and the as-of join, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions import interval as iv
from factlens.operators import asof, dyadic, graph, traversal
from factlens.plans import facts as plans
from factlens.plans.facts import EDGE, FACTS, Q3, facts, table
from factlens.sources.scratch import new_folder
from factlens.sources.store import write_by_validity


def stored_window_snapshot(spark, sf):
    """The facts of a window from a table that is kept in the order of validity."""
    folder = new_folder(spark)
    rows = facts(spark, sf)
    write_by_validity(rows, folder)
    return graph.edges_valid(spark.read.schema(rows.schema).parquet(folder), window=Q3).select(*EDGE)


def stored_neighbors_2hop(spark, sf):
    """Two hops over an adjacency that is kept by buckets; lines that differ have another chunk or edge_seq."""
    return graph.neighbors(traversal.store_adjacency(facts(spark, sf).select(*EDGE, "edge_seq")), "customer#7", 2, window=Q3).select(*EDGE, "hop")


def stored_bfs(spark, sf):
    seeds = spark.range(1).select(F.lit("The Customer#7").alias("name"))
    rows = facts(spark, sf).select("subject", "predicate", "object", "valid_from", "valid_until", "edge_seq")
    return graph.time_sliced_bfs(traversal.store_adjacency(rows), seeds, 2, Q3, most=40).select("subject", "predicate", "object", "edge_seq", "hop")


def _spans(spark, sf) -> DataFrame:
    """Ten days from each order's day."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("customer#"), F.col("o_custkey").cast("string")).alias("subject"), day.alias("s"), F.date_add(day, 10).alias("e")).where("s IS NOT NULL")


def interval_overlap_all(spark, sf):
    """All facts, open ones too, against the spans of all orders: pairs by customer and the most of one fact."""
    counted = dyadic.overlap_counts(facts(spark, sf), _spans(spark, sf).select("s", "e"), "valid_from", "valid_until", "s", "e")
    return counted.groupBy("subject").agg(F.sum("n").alias("pairs"), F.max("n").alias("most"))


def interval_overlap_own(spark, sf):
    """All facts against the spans of the same customer's orders, as pairs, counted by customer."""
    pairs = dyadic.overlap_join(facts(spark, sf).select("subject", "valid_from", "valid_until", "edge_seq"), _spans(spark, sf), "valid_from", "valid_until", "s", "e", on=["subject"])
    return pairs.groupBy("subject").agg(F.count("*").alias("pairs"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("edge_seq").alias("facts"))


def as_of_latest(spark, sf):
    """Each event with the latest fact of the customer of the same number three years before, and whether it still holds."""
    day = F.add_months(F.col("ts").cast("date"), -36)
    events = table(spark, sf, "events").select("event_id", F.concat(F.lit("customer#"), F.col("user_id").cast("string")).alias("subject"), day.alias("day"))
    own = facts(spark, sf).select("subject", "valid_from", "valid_until", "edge_seq")
    found = asof.as_of_latest(events, own, "subject", "day", "valid_from", "edge_seq")
    holds = iv.contains("fact.valid_from", "fact.valid_until", F.col("day"))
    return found.select("event_id", F.col("fact.edge_seq").alias("edge_seq"), F.col("fact.valid_from").alias("valid_from"), F.when(F.col("fact").isNotNull(), holds).alias("holds"))


_SPANS = "spans AS (SELECT o_orderkey, 'customer#' || o_custkey AS subject, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 10 AS e FROM orders WHERE o_orderdate IS NOT NULL)"
_MET = "(valid_from IS NULL OR valid_from <= e) AND (valid_until IS NULL OR s <= valid_until)"
QUERIES = {f.__name__: f for f in (stored_window_snapshot, stored_neighbors_2hop, stored_bfs, interval_overlap_all, interval_overlap_own, as_of_latest)}
ORACLES = {
    "stored_window_snapshot": plans.ORACLES["window_snapshot"],
    "stored_neighbors_2hop": plans.ORACLES["neighbors_2hop"],
    "stored_bfs": plans.ORACLES["time_sliced_bfs"],
    "interval_overlap_all": f"""WITH {FACTS}, {_SPANS}, upto AS (SELECT s AS d, CAST(sum(count(*)) OVER (ORDER BY s) AS BIGINT) AS c FROM spans GROUP BY s),
  f AS (SELECT subject, coalesce(valid_from, DATE '0001-01-01') - 11 AS a, coalesce(valid_until, DATE '9999-12-31') AS b FROM facts),
  n AS (SELECT subject, coalesce(h.c, 0) - coalesce(l.c, 0) AS n FROM f ASOF LEFT JOIN upto h ON f.b >= h.d ASOF LEFT JOIN upto l ON f.a >= l.d)
SELECT subject, CAST(sum(n) AS BIGINT) AS pairs, max(n) AS most FROM n GROUP BY subject""",
    "interval_overlap_own": f"WITH {FACTS}, {_SPANS} SELECT subject, count(*) AS pairs, count(DISTINCT o_orderkey) AS orders, count(DISTINCT edge_seq) AS facts FROM facts JOIN spans USING (subject) WHERE {_MET} GROUP BY subject",
    "as_of_latest": f"""WITH {FACTS}, f AS (SELECT subject, valid_from, max(edge_seq) AS edge_seq, arg_max(coalesce(valid_until, DATE '9999-12-31'), edge_seq) AS until FROM facts WHERE valid_from IS NOT NULL GROUP BY subject, valid_from),
  e AS (SELECT event_id, 'customer#' || user_id AS subject, CAST(CAST(ts AS DATE) - INTERVAL 36 MONTH AS DATE) AS day FROM events)
SELECT event_id, edge_seq, valid_from, until >= day AS holds FROM e ASOF LEFT JOIN f ON e.subject = f.subject AND e.day >= f.valid_from""",
}
