"""Ingestion of pages into a store: by batch, and by micro-batches of new files that are put together to whole documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factlens.functions.embed import DIMENSIONS, embed
from factlens.operators.chunking import OVERLAP, SIZE, chunk_documents
from factlens.operators.extraction import Extraction, Load, extract_chunks
from factlens.operators.graph import upsert_edges
from factlens.sources.scratch import saved
from factlens.sources.store import CHUNKS, EDGES, TABLES, Store

PAGES = "doc_id string, page int, text string"
#: Pages as they arrive: with how many their document has, if that is known.
ARRIVING = f"{PAGES}, pages int"


def chunk_table(chunks: DataFrame, found: Extraction, dimensions: int = DIMENSIONS) -> DataFrame:
    """Chunks (from chunk_documents) with what was found in them as rows of the chunk table."""
    names = found.entities.groupBy("chunk_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])).alias("entities"))
    vectors = embed(chunks, ["chunk_id"], dimensions=dimensions)
    rows = chunks.join(found.windows, "chunk_id").join(names, "chunk_id", "left").join(vectors, "chunk_id")
    return rows.select("chunk_id", "doc_id", F.col("doc_id").alias("doc_name"), "text", F.col("page_start").alias("page"), "w.start", "w.end", "w.start_label", "w.end_label", "entities", "vector").select(*CHUNKS.names)


#: Tasks that number a batch's edges, and bits of an ordinal for the task and for its rows.
TASKS, TASK_BITS, ROW_BITS = 1 << 13, 13, 30


def edge_table(relations: DataFrame, batch: int = 0) -> DataFrame:
    """Relations as rows of the edge table. edge_seq is the order of ingestion: by batch, document, chunk and place in the chunk, no
    number twice."""
    rows = relations.select("subject", "predicate", "object", "valid_from", "valid_until", "start_label", "end_label", "doc_id", "chunk_id", F.col("sentence").alias("evidence"), "confidence", F.col("position").cast("long").alias("edge_seq"))
    kept = upsert_edges(None, rows).select(*EDGES.names)
    order = ["doc_id", F.length("chunk_id"), "chunk_id", "edge_seq", "subject", "object"]
    parts = min(TASKS, int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id has the task's number above 33 bits of its rows'.
    at = F.monotonically_increasing_id()
    task, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("edge_seq", F.lit(batch << (TASK_BITS + ROW_BITS)) + task * (1 << ROW_BITS) + row)


def ingest(store: Store, pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, dimensions: int = DIMENSIONS, load: Load | None = None, source: tuple[str, int] | None = None) -> bool:
    """pages written to the store as a batch, in place of what it holds of their documents; with a model (`load`, see
    operators.extraction) its entities and relations. A document without text is a failed one. source: a stream's name and
    the micro-batch; one that the store has is left out, and False returned."""
    if source and store.has(*source):
        return False
    batch = store.reserve()
    chunks = saved(chunk_documents(pages, size, overlap))
    found = extract_chunks(chunks, load)
    chunks = store.put("chunks", chunk_table(chunks, found, dimensions), batch)
    named = found.entities.select("name", "type", "aliases", "doc_id", F.col("rank").cast("long").alias("seq"))
    edges, mentions = store.put_graph(edge_table(found.relations, batch), named, batch)
    states = pages.select("doc_id").where("doc_id IS NOT NULL").distinct()
    for name, rows in (("chunk_count", chunks), ("entity_count", mentions.select("doc_id", "name").distinct()), ("relation_count", edges)):
        states = states.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    empty = F.col("chunk_count") == 0
    store.put("states", states.select("doc_id", F.when(empty, "failed").otherwise("indexed").alias("status"), F.when(empty, "no text to extract").alias("error"), "chunk_count", "entity_count", "relation_count", F.lit(batch).cast("long").alias("version")), batch)
    return store.commit(batch, [*TABLES, "states"], source=source)


def whole_documents(arriving: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """Of a stream of pages (doc_id, page, text, pages) all pages of each document that got new ones: once it has as many pages as
    `pages` says (of those known the largest), at each arrival if it doesn't say, and when no page has come for timeout_ms.

    A document's pages are kept until then, so pages of later micro-batches join those before them, and a page that comes
    again replaces the one of its number. After the timeout a document is forgotten, and a later page begins a new version.
    Rows without doc_id are dropped.
    """

    def put_together(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # total: -1 as long as nothing is known.
        held, total = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -1)
        if state.hasTimedOut:
            ready = len(held) < total  # else it went out when its last page came
            state.remove()
        else:
            for batch in rows:
                for page, text, pages in zip(batch["page"], batch["text"], batch["pages"], strict=True):
                    held["" if pd.isna(page) else str(int(page))] = None if text is None or pd.isna(text) else text
                    total = total if pd.isna(pages) else max(total, int(pages))
            ready = len(held) >= total
            state.update((json.dumps(held), total))
            state.setTimeoutDuration(timeout_ms)
        if ready:
            yield pd.DataFrame({"doc_id": [key[0]] * len(held), "page": pd.array([int(p) if p else None for p in held], "Int32"), "text": [*held.values()]})

    keyed = arriving.where("doc_id IS NOT NULL").groupBy("doc_id")
    return keyed.applyInPandasWithState(put_together, PAGES, "held string, total int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_stream(spark: SparkSession, store: Store, folder: str, checkpoint: str, timeout_ms: int = 600_000, **options) -> StreamingQuery:
    """New JSON files of pages (doc_id, page, text, pages) in a folder, each file once, until stopped. A micro-batch that is run again
    after a failure changes nothing."""
    source = spark.readStream.schema(ARRIVING).json(folder)

    def take(batch: DataFrame, number: int) -> None:
        pages = saved(batch)  # the state's rows, once
        if not pages.isEmpty():
            ingest(store, pages, source=(checkpoint, number), **options)

    # Timeouts are looked at when there are new files; without this the query would go on for their sake and never end.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        return whole_documents(source, timeout_ms).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)
