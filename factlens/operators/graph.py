"""The fact graph as two tables, edges and nodes, and its operators.

edges: subject, predicate, object, valid_from, valid_until, start_label, end_label, doc_id, chunk_id, evidence,
confidence, edge_seq (the order of ingestion). nodes: name, type, aliases, doc_ids, mention_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions import interval as iv
from factlens.functions.text import canonical_key, normal_name
from factlens.operators.traversal import Adjacency, Scan, reach

GENERIC_TYPES = ("", "UNKNOWN", "Other")


def edge_key() -> Column:
    return F.concat_ws(":", "doc_id", "chunk_id", "predicate")


def upsert_edges(edges: DataFrame | None, relations: DataFrame, doc_id: str | None = None) -> DataFrame:
    """edges with a document's relations in place of its old ones. Relations without subject or object are skipped; of
    relations with the same ends and the same key the last (by edge_seq) counts."""
    new = relations.withColumn("subject", normal_name("subject")).withColumn("object", normal_name("object"))
    new = new.where((F.coalesce("subject", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != ""))
    cols = new.columns
    last = new.groupBy("subject", "object", edge_key().alias("_key")).agg(F.max_by(F.struct(*cols), "edge_seq").alias("e")).select("e.*")
    if edges is None:
        return last
    docs = last.select("doc_id").distinct() if doc_id is None else None
    old = edges.where(F.col("doc_id") != doc_id) if doc_id is not None else edges.join(docs, "doc_id", "left_anti")
    return old.unionByName(last.select(old.columns))


def node_parts(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """What each document says of each name: name, doc_id, type (with what it counts by), aliases, n (mentions). From entity
    mentions (name, type, aliases, doc_id, seq) and from the ends of edges (type Other)."""
    own = mentions.select(normal_name("name").alias("name"), "type", "aliases", "doc_id", "seq", F.lit(1).alias("n"))
    ends = edges.select(F.explode(F.array("subject", "object")).alias("name"), "doc_id").distinct()
    ends = ends.select("name", F.lit("Other").alias("type"), F.lit(None).cast("array<string>").alias("aliases"), "doc_id", F.lit(1 << 60).cast("long").alias("seq"), F.lit(0).alias("n"))
    rows = own.unionByName(ends).where(F.coalesce("name", F.lit("")) != "")
    generic = F.coalesce(F.col("type"), F.lit("")).isin(*GENERIC_TYPES).cast("int")
    return rows.groupBy("name", "doc_id").agg(
        F.min(F.struct(generic.alias("generic"), "seq", "type")).alias("type"),
        F.min(F.struct((F.col("n") == 0).cast("int").alias("end"), "seq", "aliases")).alias("aliases"),
        F.sum("n").cast("long").alias("n"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Nodes from parts of any documents: name, type (the first that says something, else the first), aliases (those of the first
    mention), doc_ids, mention_count."""
    return parts.groupBy("name").agg(
        F.min("type")["type"].alias("type"),
        F.min("aliases")["aliases"].alias("aliases"),
        F.sort_array(F.collect_set("doc_id")).alias("doc_ids"),
        F.sum("n").cast("long").alias("mention_count"),
    )


def merge_nodes(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes from entity mentions and from the ends of edges."""
    return merge_parts(node_parts(mentions, edges))


def remove_document(edges: DataFrame, nodes: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a document's edges and without nodes that no edge touches then."""
    left = edges.where(F.col("doc_id") != doc_id)
    return left, nodes.join(orphans(left, nodes), "name", "left_anti")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subject").alias("name")).unionByName(edges.select(F.col("object").alias("name"))).distinct()
    return nodes.join(ends, "name", "left_anti").select("name")


def edges_valid(edges: DataFrame, at=None, window: tuple | None = None) -> DataFrame:
    """Edges valid on a day or at some time of a window (which comes first)."""
    if window is not None:
        return edges.where(iv.valid_within("valid_from", "valid_until", *window))
    return edges if at is None else edges.where(iv.valid_at("valid_from", "valid_until", at))


def degree(edges: DataFrame) -> DataFrame:
    """name, degree: edges in and out, parallel ones counted, a loop twice. Counted by ends first, so that a hub meets in
    one task as a few partial counts."""
    return edges.select(F.explode(F.array("subject", "object")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def snapshot(edges: DataFrame, nodes: DataFrame | None = None, at=None, window: tuple | None = None, names: list[str] | None = None, most: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a time slice: the first `most` edges by edge_seq, and their ends with whole-graph degrees."""
    found = edges_valid(edges, at, window)
    if names is not None:
        found = found.where(F.col("subject").isin(names) | F.col("object").isin(names))
    if most is not None:
        found = found.orderBy("edge_seq").limit(most)
    ends = found.select(F.col("subject").alias("name")).unionByName(found.select(F.col("object").alias("name"))).distinct()
    out = ends.join(degree(edges), "name", "left")
    if nodes is not None:
        out = out.join(nodes, "name", "left")
    return found, out


def _source(edges: DataFrame | Adjacency, at=None, window: tuple | None = None, canonical: bool = False) -> Scan | Adjacency:
    """Where a traversal reads the edges of a time slice."""
    if isinstance(edges, Adjacency):
        return Adjacency(edges_valid(edges.rows, at, window), edges.columns, canonical)
    return Scan(edges_valid(edges, at, window), canonical)


def neighbors(edges: DataFrame | Adjacency, name: str, hops: int = 1, at=None, window: tuple | None = None, bag: bool = False) -> DataFrame:
    """Edges within 1 to 3 hops of an entity, with the hop; `bag` repeats an edge at each hop that reaches it."""
    hops = min(3, max(1, hops))
    source = _source(edges, at, window)
    spark = (edges.rows if isinstance(edges, Adjacency) else edges).sparkSession
    # One constant row, of a name as it is stored.
    start = spark.range(1).select(normal_name(F.lit(name)).alias("name"))
    found = source.reached(reach(source, start, hops)).select(*edges.columns, (F.col("dist") + 1).alias("hop"))
    return found if bag else found.groupBy(*edges.columns).agg(F.min("hop").alias("hop"))


def time_sliced_bfs(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int = 2, window: tuple | None = None, most: int | None = 40) -> DataFrame:
    """Facts reached from seed names (column name) in a time slice, by canonical names, each (subject, predicate, object)
    once (the first by hop, then edge_seq), the first `most` of them."""
    source = _source(edges, window=window, canonical=True)
    found = source.reached(reach(source, seeds.select(canonical_key("name").alias("name")), hops))
    # Equal facts have equal ends, so they are reached at the same hops.
    facts = found.groupBy("subject", "predicate", "object").agg(F.min_by(F.struct(*edges.columns, (F.col("dist") + 1).alias("hop")), F.struct("dist", "edge_seq")).alias("e")).select("e.*")
    return facts if most is None else facts.orderBy("hop", "edge_seq").limit(most)


def evolution(edges: DataFrame, name: str, predicate: str | None = None) -> DataFrame:
    """An entity's facts over time: open starts first, open ends last; evidence cut to 240 characters."""
    found = edges.where((F.col("subject") == normal_name(F.lit(name))) | (F.col("object") == normal_name(F.lit(name))))
    if predicate is not None:
        found = found.where(F.col("predicate") == predicate)
    return found.withColumn("evidence", F.substring("evidence", 1, 240)).orderBy(F.asc_nulls_first("valid_from"), F.asc_nulls_last("valid_until"), "edge_seq")


def stat_parts(edges: DataFrame) -> DataFrame:
    """What the statistics need of each document and predicate: counts and the range of dates."""
    return edges.groupBy("doc_id", "predicate").agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("valid_from").isNotNull()).alias("validated"),
        F.count_if(F.col("valid_until").isNull()).alias("open_ended"),
        F.min("valid_from").alias("earliest"),
        F.max("valid_until").alias("latest"),
    )


def merge_stats(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row from the parts of any documents: counts, histograms of types and predicates, dated and open edges, the range of
    dates."""
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    total = parts.agg(number("edges").alias("edge_count"), F.count_distinct("doc_id").alias("doc_count"), number("validated").alias("validated_edges"), number("open_ended").alias("open_ended_edges"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    by = lambda df, c, n, name: df.groupBy(c).agg(n.alias("count")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "count")))).alias(name))
    types = nodes.withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))
    # Four tables of one row each.
    return total.crossJoin(nodes.agg(F.count("*").alias("node_count"))).crossJoin(by(types, "type", F.count("*"), "entity_types")).crossJoin(by(parts, "predicate", F.sum("edges"), "predicates"))


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return merge_stats(stat_parts(edges), nodes)


def edge_model(edges: DataFrame) -> DataFrame:
    """Edges as results name their columns."""
    return edges.select("subject", "predicate", "object", F.col("valid_from").alias("start"), F.col("valid_until").alias("end"), "start_label", "end_label", "doc_id", "chunk_id", "evidence", F.coalesce("confidence", F.lit(0.5)).alias("weight"))


def graphml_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph's elements as GraphML lines (column value), nodes first; see sources.store.write_graphml for the frame."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
    data = lambda c: F.concat(F.lit(f'<data key="{c}">'), esc(F.col(c)), F.lit("</data>"))
    node = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('">'), data("type"), F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), esc(F.col("subject")), F.lit('" target="'), esc(F.col("object")), F.lit('">'), *[data(c) for c in ("predicate", "valid_from", "valid_until", "doc_id", "chunk_id")], F.lit("</edge>")).alias("value"))
    return node.unionByName(edge)
