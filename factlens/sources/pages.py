"""Documents as pages: text files, page tables, and files that a given parser reads (PDF)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 << 20


def pages_from_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, text of whole text files; form feeds part pages."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), "value")
    return rows.select("doc_id", F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def uploads(spark: SparkSession, path: str, pattern: str = r"(?i)\.pdf$", most: int = MOST_BYTES) -> DataFrame:
    """Binary files by name pattern and size."""
    return spark.read.format("binaryFile").load(path).where(F.col("path").rlike(pattern) & (F.col("length") <= most))


def pages_from_files(files: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, page, text, error: a parser (bytes to page texts) run on each file where it lies; a file that it fails on
    gives one row with the error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rpartition("/")[2]
                try:
                    rows += [(name, i, text, None) for i, text in enumerate(parser(bytes(content)), 1)]
                except Exception as e:  # the parser is the caller's
                    rows.append((name, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(parse, "doc_id string, page int, text string, error string")


def failed_documents(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, error of documents without any text or without chunks."""
    by = pages.groupBy("doc_id").agg(F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("n"))
    some = chunks.select("doc_id").distinct().withColumn("ok", F.lit(True))
    out = by.join(some, "doc_id", "left").where("n = 0 OR ok IS NULL")
    return out.select("doc_id", F.when(F.col("n") == 0, "no extractable text").otherwise("no chunks").alias("error"))
