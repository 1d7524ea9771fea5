"""The corpus pipeline: documents through five training-data operators, one stage after the other.

Each stage takes what the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlens.llm.common import saved, table
from factlens.llm.decontamination import decontaminate
from factlens.llm.near_dedup import deduplicated
from factlens.llm.quality_rules import fit_references, judge_quality
from factlens.llm.secret_scans import redact_secrets
from factlens.llm.sentencepiece_codec import encode_texts

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, against references from all labelled ones among the documents."""
    references = fit_references(docs, table(spark, sf_dir, "labels"), rows=None, languages=None)
    # Written first: in one plan the filter would go below the projection and work out all figures a second time.
    return saved(judge_quality(docs, references, keep=True)).where("kept").select("input.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets; n_chars follows."""
    return redact_secrets(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids: doc_id, n_tokens, ids, round_trip."""
    return encode_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("sentencepiece", sentencepiece),
]
#: The alignment, the automaton's redaction and the token ids are beyond SQL: tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table; between stages the rows are written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
