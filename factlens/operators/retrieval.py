"""Retrieval: windowed exact top-k, broad recall, seeds, time-sliced traversal."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions import interval as iv
from factlens.functions.embed import DIMENSIONS, embed, squared_distance
from factlens.functions.text import canonical_name, jaccard, search_tokens
from factlens.functions.window import DateWindow, parse_window
from factlens.operators.graph import time_sliced_bfs
from factlens.operators.traversal import Adjacency

TOP_K, HOPS, MOST_EDGES, MOST_SEEDS = 6, 2, 40, 12
SEED_LIKENESS = 0.4


def nearest(chunks: DataFrame, vector: list[float], k: int = TOP_K, window: tuple = (None, None), id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """The k chunks nearest to a vector (squared Euclidean, ties by id) of those valid within the window, with score. The
    window is a filter before the ranking, so the scan prunes by it; the ranking keeps k rows a task."""
    rows = chunks.where(iv.valid_within("start", "end", *window)) if any(w is not None for w in window) else chunks
    query = F.array(*[F.lit(float(x)) for x in vector])
    return rows.withColumn("score", squared_distance(F.col(vector_col), query)).orderBy("score", id_col).limit(k)


def with_broad_recall(hits: DataFrame, chunks: DataFrame, vector: list[float], k: int = TOP_K, windowed: bool = True, id_col: str = "chunk_id") -> DataFrame:
    """hits and, if a window left fewer than max(4, k), the nearest max(8, k + 4) chunks of any time behind them, with
    lens (0: in the window, 1: beyond)."""
    own = hits.withColumn("lens", F.lit(0))
    if not windowed or hits.count() >= max(4, k):
        return own
    more = nearest(chunks, vector, max(8, k + 4), id_col=id_col).join(hits.select(id_col), id_col, "left_anti")
    return own.unionByName(more.withColumn("lens", F.lit(1)))


def distinct_seeds(names: Column, most_alike: float = SEED_LIKENESS) -> Column:
    """Of an ordered array of names those whose words are not too like those of a name kept before."""
    kept = "array<struct<name:string,words:array<string>>>"
    keep = lambda acc, x: F.when(F.exists(acc, lambda h: jaccard(x["words"], h["words"]) > most_alike), acc).otherwise(F.concat(acc, F.array(x))).cast(kept)
    # A name's words are looked for once, not with each name that it is compared with.
    worded = F.transform(names, lambda x: F.struct(x.alias("name"), search_tokens(x).alias("words")))
    return F.aggregate(worded, F.array().cast(kept), keep, lambda acc: F.transform(acc, lambda x: x["name"]))


def question_names_node(name: Column, question: Column) -> Column:
    """Whether a question holds nearly all words of a name with two words or more."""
    words = search_tokens(canonical_name(name))
    n = F.size(words)
    return (n >= 2) & (F.size(F.array_intersect(words, search_tokens(question))) >= F.greatest(F.lit(2), n - 1))


def seeds(hits: DataFrame, nodes: DataFrame, question: str, most: int = MOST_SEEDS) -> DataFrame:
    """Up to `most` names: those of the hits (at most a few rows) without near repeats, then nodes the question names."""
    names = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lens", "score", "chunk_id", F.coalesce("entities", F.array().cast("array<string>")).alias("e")))), lambda h: h["e"]))
    own = hits.agg(distinct_seeds(names).alias("a")).select(F.posexplode("a").alias("i", "name")).withColumn("source", F.lit(0))
    asked = nodes.where(question_names_node(F.col("name"), F.lit(question))).select(F.lit(0).alias("i"), "name", F.lit(1).alias("source"))
    return own.unionByName(asked.select("i", "name", "source")).orderBy("source", "i", "name").limit(most)


@dataclass
class Context:
    """What a question was answered from. hits, edges and seeds are a few rows, kept on the driver."""

    question: str
    window: DateWindow
    hits: DataFrame
    edges: DataFrame
    seeds: DataFrame
    trace: list[str] = field(default_factory=list)


def _few(df: DataFrame) -> DataFrame:
    """A few rows as a local table, so that what gave them isn't run again by each reader."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def resolve_window(question: str, start=None, end=None, label: str | None = None, as_of: date | None = None) -> DateWindow:
    """Explicit bounds, else the window that the label or a start in words names, else the one the question names."""
    if isinstance(start, str) and end is None:
        try:
            start = date.fromisoformat(start)
        except ValueError:
            return parse_window(start, as_of)
    if start is not None or end is not None:
        return DateWindow(start, end, label or str(iv_label(start, end)))
    return parse_window(label, as_of) if label else parse_window(question, as_of)


def iv_label(start, end) -> str:
    """'' for no window, one day as of, else both ends."""
    if start is None and end is None:
        return ""
    return f"{start} (as of)" if start == end else f"{start or '…'} → {end or '…'}"


def retrieve(question: str, chunks: DataFrame, edges: DataFrame | Adjacency, nodes: DataFrame, *, start=None, end=None, label: str | None = None, k: int = TOP_K, hops: int = HOPS, most_edges: int = MOST_EDGES, dimensions: int = DIMENSIONS, as_of: date | None = None) -> Context:
    window = resolve_window(question, start, end, label, as_of)
    spark = chunks.sparkSession
    vector = embed(spark.createDataFrame([(1, question)], "i int, text string"), ["i"], dimensions=dimensions).first()["vector"]
    # At most k and max(8, k + 4) hits, MOST_SEEDS seeds and most_edges facts.
    hits = _few(with_broad_recall(_few(nearest(chunks, vector, k, window.bounds)), chunks, vector, k, not window.is_empty))
    found = _few(seeds(hits, nodes, question))
    facts = _few(time_sliced_bfs(edges, found, hops, window.bounds, most_edges))
    lenses = [r["lens"] for r in hits.select("lens").collect()]
    names, n_facts = [r["name"] for r in found.collect()], facts.count()
    trace = [f"parsed window from question: '{window.label}'"] if start is end is label is None and not window.is_empty else []
    trace.append("no temporal filter (open window)" if window.is_empty else f"temporal filter applied: [{window.start or '…'} → {window.end or '…'}]")
    extra = f", +{sum(lenses)} broad-recall" if sum(lenses) else ""
    trace.append(f"vector search: {len(lenses)} chunk hits (top_k={k}{extra})")
    trace += [f"seed entities: {names[:8]}"] if names else []
    trace += [f"graph lens: {n_facts} interval-validated facts via {len(names)} seeds"] if n_facts else []
    return Context(question, window, hits, facts, found, trace)
