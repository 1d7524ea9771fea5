"""Entities, dated relations and windows of chunks: by a given model where it answers, by rules everywhere else.

A model is given as `load`: a function without arguments that runs once per task on an executor and returns a function from a
prompt to a reply. A reply is JSON, perhaps with words or a fence around it. Where the model raises, says nothing, gives no JSON or
neither an entity nor a relation, the rules decide for that chunk alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.extract import chunk_window, relation_frames, reply_entities, reply_relations, reply_windows, typed_entities
from factlens.sources.scratch import saved

Load = Callable[[], Callable[[str], str | None]]
IDS = ["doc_id", "chunk_id"]


def replies(rows: DataFrame, prompt: Column, load: Load) -> DataFrame:
    """rows with the model's reply to each prompt, and the error where it raised one (then the reply is null). The rows are written
    once, so that no prompt is asked twice."""

    @F.pandas_udf("reply string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for prompts in batches:
            out = []
            for text in prompts:
                try:
                    said = model(text)
                    out.append((None if said is None else str(said), None))
                except Exception as e:  # the model is the caller's
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["reply", "error"])

    return saved(rows.withColumn("_said", ask(prompt)).select(*rows.columns, "_said.reply", "_said.error"))


def chunk_prompt() -> Column:
    """What a model is asked about a chunk."""
    asked = (
        'List the entities and the dated relations of this passage as JSON: {"entities": [{"name", "type", "aliases"}], "relations": [{"subject", "predicate", "object", "validity": {"start", "end"}, "sentence"}], '
        '"chunk_temporal": {"start", "end"}}; dates as YYYY-MM-DD or null.'
    )
    return F.concat(F.lit(f"{asked}\nDocument "), F.coalesce("doc_id", F.lit("")), F.lit(", passage "), "chunk_id", F.lit(":\n"), F.coalesce("text", F.lit("")))


class Extraction(NamedTuple):
    """entities: doc_id, chunk_id, name, type, aliases, rank; relations: those of relation_frames; windows: chunk_id, w (start, end,
    start_label, end_label); engines: chunk_id, engine (model or rules), error (why a model gave nothing, if it raised)."""

    entities: DataFrame
    relations: DataFrame
    windows: DataFrame
    engines: DataFrame


def extract_chunks(chunks: DataFrame, load: Load | None = None, prompt: Column | None = None) -> Extraction:
    """Of chunks (doc_id, chunk_id, text)."""
    chunks = chunks.select(*IDS, "text")
    no_aliases = F.lit(None).cast("array<string>").alias("aliases")
    if load is None:
        named = typed_entities(chunks, IDS).select(*IDS, "name", "type", no_aliases, "rank")
        engines = chunks.select("chunk_id", F.lit("rules").alias("engine"), F.lit(None).cast("string").alias("error"))
        return Extraction(named, relation_frames(chunks, IDS), chunks.select("chunk_id", chunk_window("text").alias("w")), engines)
    said = replies(chunks, chunk_prompt() if prompt is None else prompt, load)
    names, facts = reply_entities(said, IDS), reply_relations(said, IDS)
    used = names.select(*IDS).unionByName(facts.select(*IDS)).distinct()
    rest = chunks.join(used, IDS, "left_anti")
    entities = names.select(*IDS, "name", "type", "aliases", F.col("position").alias("rank"))
    entities = entities.unionByName(typed_entities(rest, IDS).select(*IDS, "name", "type", no_aliases, "rank"))
    ruled = relation_frames(rest, IDS)
    relations = facts.select(ruled.columns).unionByName(ruled)
    # A window that the model leaves open on both sides is read from the text.
    stated = reply_windows(said.join(used, IDS, "left_semi"), ["chunk_id"]).where("w.start IS NOT NULL OR w.end IS NOT NULL").select("chunk_id", F.col("w").alias("_w"))
    windows = chunks.select("chunk_id", chunk_window("text").alias("w")).join(stated, "chunk_id", "left").select("chunk_id", F.coalesce("_w", "w").alias("w"))
    mark = used.select("chunk_id", F.lit("model").alias("engine"))
    engines = said.select("chunk_id", "error").join(mark, "chunk_id", "left").select("chunk_id", F.coalesce("engine", F.lit("rules")).alias("engine"), "error")
    return Extraction(entities, relations, windows, engines)
