"""The engine: a store and the questions it answers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.window import parse_window
from factlens.operators import answers, graph, intervals, retrieval
from factlens.operators.extraction import Load
from factlens.sources.store import Store
from factlens.streaming.ingest import ingest


class Engine:
    def __init__(self, spark: SparkSession, path: str, dimensions: int = 768, size: int = 800, overlap: int = 120):
        self.store, self.dimensions, self.size, self.overlap = Store(spark, path), dimensions, size, overlap

    def ingest(self, pages: DataFrame, load: Load | None = None) -> None:
        """Pages as a batch; with a model (load, see operators.extraction) what it reads from them."""
        ingest(self.store, pages, self.size, self.overlap, self.dimensions, load)

    def retrieve(self, question: str, **options) -> retrieval.Context:
        return retrieval.retrieve(question, self.store.chunks(), self.store.adjacency(), self.store.nodes(), dimensions=self.dimensions, **options)

    def query(self, question: str, load: Load | None = None, **options) -> DataFrame:
        return answers.answer(self.retrieve(question, **options), load)

    def compare(self, question: str, a: str, b: str, **options) -> tuple[DataFrame, DataFrame]:
        return answers.compare(self.retrieve(question, label=a, **options), self.retrieve(question, label=b, **options))

    def graph_diff(self, a: str, b: str, as_of: date | None = None) -> DataFrame:
        edges = self.store.edges()
        return intervals.snapshot_diff(edges, edges, parse_window(a, as_of).bounds, parse_window(b, as_of).bounds)

    def snapshot(self, at=None, window: str | None = None, names: list[str] | None = None, most: int = 500) -> tuple[DataFrame, DataFrame]:
        return graph.snapshot(self.store.edges(), self.store.nodes(), at, parse_window(window).bounds if window else None, names, min(5000, max(1, most)))

    def neighbors(self, name: str, hops: int = 1, at=None, window: str | None = None, bag: bool = False) -> DataFrame:
        return graph.neighbors(self.store.adjacency(), name, hops, at, parse_window(window).bounds if window else None, bag)

    def evolution(self, name: str, predicate: str | None = None) -> DataFrame:
        return graph.evolution(self.store.edges(), name, predicate)

    def stats(self) -> DataFrame:
        return self.store.stats()

    def health(self) -> DataFrame:
        """One row: how many chunks, documents, nodes and edges the store holds, and the vectors' width."""
        chunks = self.store.chunks().agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max(F.size("vector")).alias("dimensions"))
        return chunks.crossJoin(self.store.nodes().agg(F.count("*").alias("nodes"))).crossJoin(self.store.edges().agg(F.count("*").alias("edges")))

    def delete_document(self, doc_id: str) -> None:
        """A document's chunks, edges and mentions, and so the nodes that only it held."""
        self.store.delete_document(doc_id)
