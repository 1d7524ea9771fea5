"""SentencePiece encoding and decoding by max-plus parallel scan (see max_plus.py), over DataFrames.

Texts of up to GIANT characters are one row's work: up to two chunks' length they are one chunk, and beyond the chunks' matrices
are scanned there (at sf0.1 24 % of all characters). Longer ones are dealt out: each chunk, with a piece's
width of context on either side, is a row of its own; its transfer matrix is worked out anywhere, the matrices of a text
(a few hundred numbers a chunk) meet for the scan, and each chunk is traced back by itself.

The ids are those of the sentencepiece library for the same model, BPE or unigram. Edge cases: a null or empty text has
no ids; repeated rows are encoded one by one; a text that holds the model's own space sign U+2581 decodes to spaces
there (round_trip is false); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import Kept, saved, slices, table
from factlens.llm.max_plus import SPACE, Lattice, Model, scan

#: The model that read_model takes where no path is given: a public one on the driver.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 1 << 15, 1 << 14
#: One lattice per Python worker and model.
_LATTICE = Kept()


def read_model(path: str = MODEL_PATH) -> Model:
    with open(path, "rb") as file:
        return Model.read(file.read())


def encode_texts(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids, round_trip (whether the ids decode to the text)."""
    model = model or read_model()
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind}, n_tokens long, ids array<int>, round_trip boolean"

    def finished(ids: pa.Array, texts: list[str], found: list[list[int]], lattice: Lattice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(map(len, found), pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array([lattice.decode(x) == t for x, t in zip(found, texts, strict=True)])],
            names=["id", "n_tokens", "ids", "round_trip"],
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _LATTICE.get(sent.value, Lattice)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            yield finished(batch.column("id"), texts, [lattice.encode(x) for x in texts], lattice)

    small = rows.where(F.length("text") <= giant).mapInArrow(whole, schema)
    large = saved(rows.where(F.length("text") > giant).withColumn("rid", F.monotonically_increasing_id()))
    pieces = _chunks(large, model, chunk)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _LATTICE.get(sent.value, Lattice)
        for batch in batches:
            for r in batch.to_pylist():
                found = lattice.transfer(r["s"], r["b0"], r["b1"], r["last"])
                cells = [[*e, *x, w] for e, row in found.items() for x, w in row.items()]
                cols = [pa.array([c[i] for c in cells], pa.float64() if i == 4 else pa.int32()) for i in range(5)]
                n = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([r["rid"]] * n, pa.int64()), pa.array([r["k"]] * n, pa.int32()), *cols], names=["rid", "k", "e0", "e1", "x0", "x1", "w"])

    def scanned(cells: pd.DataFrame) -> pd.DataFrame:
        parts: list[dict] = [{} for _ in range(int(cells["k"].max()) + 1)]
        for k, e0, e1, x0, x1, w in zip(*(cells[c].tolist() for c in ("k", "e0", "e1", "x0", "x1", "w")), strict=True):
            parts[k].setdefault((e0, e1), {})[x0, x1] = w
        path = scan(parts)
        return pd.DataFrame([(cells["rid"].iloc[0], k, *path[k], *path[k + 1]) for k in range(len(parts))], columns=["rid", "k", "e0", "e1", "x0", "x1"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _LATTICE.get(sent.value, Lattice)
        for batch in batches:
            found = [lattice.trace(r["s"], r["b0"], r["b1"], r["last"], (r["e0"], r["e1"]), (r["x0"], r["x1"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), pa.array(found, pa.list_(pa.int32()))], names=["rid", "k", "ids"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _LATTICE.get(sent.value, Lattice)
        for batch in slices(batches, "text", 4 << 20):
            yield finished(batch.column("id"), batch.column("text").to_pylist(), batch.column("ids").to_pylist(), lattice)

    cells = pieces.mapInArrow(matrices, "rid long, k int, e0 int, e1 int, x0 int, x1 int, w double")
    path = cells.groupBy("rid").applyInPandas(scanned, "rid long, k int, e0 int, e1 int, x0 int, x1 int")
    parts = pieces.join(path, ["rid", "k"]).mapInArrow(traced, "rid long, k int, ids array<int>")
    joined = parts.groupBy("rid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = small.unionByName(large.join(joined, "rid").select("id", "text", "ids").mapInArrow(checked, schema))
    return out.withColumnRenamed("id", id_col)


def _chunks(large: DataFrame, model: Model, chunk: int) -> DataFrame:
    """The texts' chunks: rid, k, the characters with context (s), the chunk's bounds in them (b0, b1), last."""
    width = max((len(p) for p, _, _ in model.pieces), default=1)
    s = F.concat(F.lit(SPACE if model.dummy_prefix else ""), F.translate("text", " ", SPACE))
    rows = large.select("rid", s.alias("s")).withColumn("n", F.length("s"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    low, end = F.greatest(F.lit(0), F.col("k") * chunk - width), F.least(F.col("n"), (F.col("k") + 1) * chunk)
    cut = rows.select("rid", "k", F.substring(F.col("s"), low + 1, F.lit(chunk + 2 * width)).alias("s"), (F.col("k") * chunk - low).alias("b0"), (end - low).alias("b1"), (end == F.col("n")).alias("last"))
    return cut.repartition("rid", "k")


def decode_ids(encoded: DataFrame, model: Model | None = None, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the decoded texts as column text_col (null ids decode to null)."""
    sent = encoded.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        lattice = _LATTICE.get(sent.value, Lattice)
        return ids.map(lambda x: None if x is None else lattice.decode(x))

    return encoded.withColumn(text_col, decode(F.col(ids_col)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op1_sentencepiece": op1_sentencepiece}, {}
