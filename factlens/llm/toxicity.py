"""Toxicity scores by a subsequence string kernel's support vector machine (see string_kernel.py).

Training takes a bounded sample of labelled rows: of the rows that are not held out, up to MAX_TOXIC toxic ones and
MAX_CLEAN others, those whose ids and texts hash lowest. Their texts stay on the executors: words are counted there, and
what comes to the driver are CANDIDATES words with their counts and a row of numbers for each sampled text. A row is held
out if crc32 of its id as text is divisible by FOLDS. Only texts are inputs of a score.

Edge cases: a null or empty text has no words and scores like any text without likeness to an insult; without labelled
rows all texts score low; an id with several labels or texts counts each pair; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import Kept, Scratch, slices, table, texts
from factlens.llm.string_kernel import LANDMARKS, Reader, Scorer, choose_landmarks, fit, marred, openings

FOLDS, MAX_TOXIC, MAX_CLEAN = 5, 1500, 3500
#: Words that are candidates for landmarks, by how much more often they stand in toxic texts.
CANDIDATES = 4000


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded sample of labelled texts: text, label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # The texts stay out of the choice, so that no task or driver holds them for it.
    pairs = known.join(rows.select("id", "h"), "id").select("id", "label", "h").distinct()
    order = [F.xxhash64(F.lit(11), "id"), F.col("id"), F.col("h")]
    sample = pairs.where("label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(pairs.where("label = 0").orderBy(*order).limit(MAX_CLEAN))
    # The sample has MAX_TOXIC + MAX_CLEAN rows at most.
    return rows.join(F.broadcast(sample), ["id", "h"]).dropDuplicates(["id", "h", "label"]).select("text", "label")


def train(sample: DataFrame, most: int = LANDMARKS) -> Scorer:
    """A scorer trained on texts and labels (text, label)."""
    work = Scratch(sample.sparkSession)
    sample = work.save("sample", sample.select(F.coalesce("text", F.lit("")).alias("text"), "label"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                found = sorted(openings(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["word", "label"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    counts = sample.mapInArrow(words, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).where("toxic >= 3")
    a, b = F.col("toxic") / n1, (F.col("n") - F.col("toxic")) / n0
    excess = (a - b) / F.sqrt((a + b) / n1 + 1.0 / n1 / n1)
    # A candidate is held more often than by chance.
    ranked = counts.where(excess >= 2).orderBy(F.desc(excess), F.desc(F.length("word")), "word").limit(CANDIDATES).select("word", "toxic").collect()
    marks = choose_landmarks([(r["word"], r["toxic"]) for r in ranked], most)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kernel values of each text, and of each toxic text with marks put into its telling words (label -1)."""
        reader = Reader(marks)
        for batch in slices(batches, "text", 1 << 20):
            own, ys = texts(batch), batch.column("label").to_pylist()
            bad = [m for i, (t, y) in enumerate(zip(own, ys, strict=True)) if y == 1 and (m := marred(t, marks, len(t) + i))]
            found = reader.values([*own, *bad])
            yield pa.RecordBatch.from_arrays([pa.array([*ys, *[-1] * len(bad)], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "values"])

    got = sample.mapInArrow(values, "label int, values binary").collect()
    work.drop("sample")
    got = sorted((r["label"], bytes(r["values"])) for r in got)
    y = np.array([k for k, _ in got], np.int64)
    x = np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, len(marks))
    # Folds must not follow the order of labels and values.
    order = np.random.Generator(np.random.PCG64(3)).permutation(np.flatnonzero(y >= 0))
    return fit(marks, x[order], y[order], x[y < 0])


#: One reader per Python worker and scorer: tasks share the words it remembers.
_READER = Kept()


def score_texts(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1)."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _READER.get(sent.value, lambda scorer: Reader(scorer.landmarks))
        for batch in slices(batches, "text", 4 << 20):
            found = sent.value.score(reader.values(texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.asarray(found, np.float64))], names=[id_col, "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"`{id_col}` {kind}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = train(training_rows(docs, table(spark, sf_dir, "labels")))
    out = score_texts(docs, scorer)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES, ORACLES = {"op3_toxicity": op3_toxicity}, {}
