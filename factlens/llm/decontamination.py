r"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for in each training text.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are put in lower case. A window is 13 consecutive words of an
item; an item with fewer words (but not none) is one window. Words of the items get numbers; a text is read as the
numbers of its words (0: in no item), so only stretches of known words are looked up, by the bytes of their numbers, in
the hash set, and a found key is the window itself: the hit is verified. Each text word inside any occurrence is hit.

The set holds MAX_WINDOWS windows at most; larger benchmarks are taken in blocks of items, one pass over the texts per
block, with the hits so far carried along in the rows.

Edge cases: a null or empty text has no words, no hits and is not contaminated; an item without words occurs nowhere;
repeated items (same text, other ids) are all listed, an id twice in the benchmark once; an item without an
id hits words but isn't listed; repeated rows are judged one by
one; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm.common import Kept, saved, slices, table

WINDOW = 13
MAX_WINDOWS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate(_UPPER)) if text else []


class Windows:
    """The items' windows: numbers of their words, and per window length a dict from a window's bytes to item ids."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.number: dict[str, int] = {}
        self.by_length: dict[int, dict[bytes, set]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(window, len(words))
            ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.int32, len(words))
            keys = self.by_length.setdefault(n, {})
            for at in range(len(ids) - n + 1):
                keys.setdefault(ids[at : at + n].tobytes(), set()).add(item)

    def find(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """The hit stretches (start, end) of words, merged and sorted, and the items that occur."""
        get = self.number.get
        ids = np.fromiter([get(w, 0) for w in words], np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        hits: list[tuple[int, int]] = []
        items: set = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            raw = ids[start:end].tobytes()
            for n, keys in self.by_length.items():
                for at in range(end - start - n + 1):
                    if found := keys.get(raw[4 * at : 4 * (at + n)]):
                        items |= found
                        hits.append((start + at, start + at + n))
        return merged(hits), items


#: The set of a broadcast block, built once per Python worker.
_BUILT = Kept()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> list[DataFrame]:
    """The benchmark in blocks of about `most` windows at most each."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    words = F.size(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0)))
    total = items.agg(F.sum(F.greatest(F.lit(1), words - (window - 1)).cast("long"))).first()[0] or 0
    n = -(-total // most) or 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, keep: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_words, hits (array of word stretches start, end; sorted, apart), items (sorted
    as strings); with keep, also the whole input row as struct `input`."""
    kind = docs.schema[id_col].dataType
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hits"), F.array().cast("array<string>").alias("items"), *whole)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = _blocks(benchmark, item_col, item_text_col, window, max_windows)
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in block.toLocalIterator()])

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = _BUILT.get(sent.value, Windows, window)
            for batch in slices(batches, "text"):
                n_words, hits, items = [], [], []
                for text, old, had in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    words = words_of(text)
                    found, which = windows.find(words) if words else ([], set())
                    n_words.append(len(words))
                    hits.append([{"start": s, "end": e} for s, e in (merged([(x["start"], x["end"]) for x in old] + found) if old else found)])
                    items.append(sorted({*had, *(str(x) for x in which if x is not None)}))
                cols = [*batch.columns[:2], pa.array(n_words, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string())), *batch.columns[5:]]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        rows = rows.mapInArrow(scan, schema)
        if k < len(blocks) - 1:
            rows = saved(rows)
    return rows.select(F.col("id").cast(kind).alias(id_col), "n_words", "hits", "items", *["input"] * keep)


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def contaminated() -> F.Column:
    """The rule: at least one word in twenty, and at least one, is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def without_spans(text: str | None, hits: list[tuple[int, int]]) -> str | None:
    """text without its hit words and what stands between them."""
    if not text or not hits:
        return text
    at = [m.span() for m in _WORDS.finditer(text.translate(_UPPER))]
    out, last = [], 0
    for s, e in hits:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join(out) + text[last:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs, without contaminated documents or (remove="spans") without the hit spans of all documents."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = find_contamination(docs, benchmark, text_col=text_col, keep=True, **options)
    if remove == "documents":
        return found.where(~contaminated()).select("input.*")

    @F.pandas_udf("string")
    def cut(text, hits):
        return text.combine(hits, lambda t, h: without_spans(t, [(x["start"], x["end"]) for x in h]))

    own = {c: F.col("input")[c] for c in docs.columns}
    return found.select(*[(cut(own[c], F.col("hits")) if c == text_col else own[c]).alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )




_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS w FROM documents),
b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM iw),
placed AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n),
hit AS (
  SELECT rid, p, a.n, item_id FROM (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM placed) a JOIN iw ON iw.win = a.win AND iw.n = a.n
), words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""
QUERIES, ORACLES = {"op7_decontamination": op7_decontamination}, {"op7_decontamination": ORACLE}
