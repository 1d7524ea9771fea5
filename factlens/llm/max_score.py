"""Exact top-k search by inner product with MaxScore over shards of postings.

Components become whole numbers, floor(SCALE * x). A shard is a block of rows with like vectors, about ROWS of them. Its postings
are made against its middle, the median of each component: the term (component, +) lists the rows above the median and how far
above, (component, -) those below. A query's score with a row is its score with the middle plus the contributions of the terms on
its own sign's side, less what the other side takes; so the middle's score plus the sum of contributions never falls short of it.

1. A query's terms are the component with the sign of its weight. A term's bound is its weight times the largest entry of its
   postings. Terms are sorted by bound: those whose bounds together with the middle's score stay below the query's threshold are
   non-essential, for a row that is in no other term's postings cannot reach the threshold.
2. The essential terms' postings are traversed and summed by row. Rows that with all other terms' bounds stay below the threshold
   go; the others are probed for the non-essential terms, largest bound first, while they are competitive. Those that
   remain get their exact scores.
3. A query's threshold is its k-th best score so far: first among SEEDS rows, then among its task's shards. Ties with
   the threshold stay competitive. Each task returns at most k rows a query, and these are merged by query.

Queries come in blocks of at most QUERY_BYTES that are broadcast, one pass over the shards a block. Shards are made by sorting
rows by the nearest of PIVOTS sampled vectors; what a shard holds affects its bounds only, never the result. Seeds and pivots are
bounded samples (rows whose numbers hash lowest); every row is in a shard.

Edge cases: rows whose vector is null, or has null or non-finite components, and rows without an id take no part; a shorter vector
counts as if zeros followed, an empty one as all zeros; repeated ids are rows of their own, and a query's own row alone is left
out; ties go to the smaller id; fewer than k candidates give fewer rows, none give none; scores beyond 64 bits are held at the
ends of the range, where they tie; extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm.common import Scratch, table

SCALE, K = 1024, 10
#: Rows of a shard, sampled rows that give first thresholds, sampled vectors by which rows are sorted, bytes of a block of queries.
ROWS, SEEDS, PIVOTS, QUERY_BYTES = 4096, 1024, 32, 32 << 20
#: Up to here sums of products are exact as doubles.
_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Vectors(NamedTuple):
    """Whole vectors as rows of one array (doubles where they are exact, else Python's integers), ids and row numbers."""

    x: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    def part(self, at) -> Vectors:
        return Vectors(self.x[at], self.ids[at], self.rows[at])


def _vectors(batch: pa.RecordBatch | pa.Table) -> Vectors:
    lists = batch.column("x")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return Vectors(out, batch.column("id").to_numpy(), batch.column("rid").to_numpy())


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width, and as integers without end where doubles would not hold their products' sums."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    tops = [float(np.abs(x).max()) if x.size else 0.0 for x in (a, b)]
    # A middle is at most as far from zero as the rows, and a row from its middle twice as far.
    if 4 * width * max(tops[0], 1) * max(tops[1], 1) >= _EXACT:
        whole = np.vectorize(int, otypes=[object])
        a, b = (whole(x) if x.size else x.astype(object) for x in (a, b))
    return a, b


def _held(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), _LEAST), _MOST) for s in scores], np.int64)
    return scores.astype(np.int64)


class Shard:
    """The postings of a block of rows against its middle."""

    def __init__(self, own: Vectors):
        self.own = own
        x = own.x
        # Whole, and a number of the column, so that it is exact.
        self.middle = np.sort(x, axis=0)[len(x) // 2]
        self.off = x - self.middle
        self.postings: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        # The middle is a row's number in each column, so neither is negative.
        self.tops = [self.off.max(axis=0), (-self.off).max(axis=0)]

    def posting(self, component: int, above: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows on one side of the middle, and how far they are from it."""
        if (component, above) not in self.postings:
            column = self.off[:, component] if above else -self.off[:, component]
            at = np.flatnonzero(column > 0)
            self.postings[component, above] = (at, column[at])
        return self.postings[component, above]

    def competitive(self, q: np.ndarray, least) -> np.ndarray:
        """Places of rows among which are all whose score with q is `least` or more (None: all rows)."""
        n = len(self.own.ids)
        if least is None:
            return np.arange(n)
        bounds = np.where(q > 0, q * self.tops[0], -q * self.tops[1])
        base = (q * self.middle).sum()
        order = np.argsort(bounds, kind="stable")
        order = order[bounds[order] > 0]
        upto = base + np.cumsum(bounds[order])
        if base >= least:  # no term is needed to reach it
            split = 0
        elif not len(order) or upto[-1] < least:
            return np.zeros(0, np.int64)
        else:
            split = int(np.argmax(upto >= least))
        # Traverse the essential postings. Where the middle alone reaches the threshold, rows in no posting are candidates too.
        sums = np.zeros(n, self.own.x.dtype)
        met = np.full(n, bool(base >= least))
        for t in order[split:].tolist():
            at, far = self.posting(t, q[t] > 0)
            sums[at] += abs(q[t]) * far
            met[at] = True
        rest = upto[split - 1] if split else base
        at = np.flatnonzero(met)
        at = at[sums[at] + rest >= least]
        # Probe the others, with what the terms still to come can add.
        for t in order[:split][::-1].tolist():
            if not len(at):
                break
            rest = rest - bounds[t]
            column = self.off[at, t]
            far = np.maximum(column if q[t] > 0 else -column, column * 0)
            sums[at] += abs(q[t]) * far
            at = at[sums[at] + rest >= least]
        return at


class Best:
    """A query's best rows so far: scores, ids, row numbers, best first."""

    def __init__(self, k: int, least=None):
        self.k, self.floor = k, least
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @property
    def least(self):
        """The threshold: the k-th best score that is known, or None."""
        own = int(self.found[0][-1]) if len(self.found[0]) == self.k else None
        known = [x for x in (own, self.floor) if x is not None]
        return max(known) if known else None

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores, ids, rows = (np.concatenate(x) for x in zip(self.found, (scores, ids, rows), strict=True))
        if self.floor is not None:
            kept = scores >= self.floor
            scores, ids, rows = scores[kept], ids[kept], rows[kept]
        order = np.lexsort((rows, ids, -1 - scores))[: self.k]  # -1 - s turns the order round without leaving 64 bits
        self.found = scores[order], ids[order], rows[order]


def search_shard(queries: Vectors, best: list[Best], own: Vectors) -> int:
    """A shard's rows offered to each query's best. Returns how many exact scores were computed."""
    scored = 0
    # Values that fit are searched as doubles, the rest in full.
    q, x = _even(queries.x, own.x)
    shard = Shard(Vectors(x, own.ids, own.rows))
    for i, b in enumerate(best):
        least = b.least
        # Held scores tell nothing about the sums beyond 64 bits, so there all rows compete.
        at = shard.competitive(q[i], None if least is not None and not _LEAST < least < _MOST else least)
        at = at[own.rows[at] != queries.rows[i]]
        if len(at):
            scored += len(at)
            b.add(_held((x[at] * q[i]).sum(axis=1) if x.dtype == object else x[at] @ q[i]), own.ids[at], own.rows[at])
    return scored


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, x (components as whole doubles) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False))).select("id", F.transform("v", lambda v: _floor(scale * v)).alias("x"))


def _floor(v: Column) -> Column:
    """floor() yields a long; components beyond that are whole as they are, and held where a double ends."""
    most = F.lit(sys.float_info.max)
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(F.least(F.greatest(v, -most), most))


def top_k(df: DataFrame, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, rows: int = ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of df that is_query (a condition on column `id`; by default ids divisible
    by 100) the k rows, its own aside, with the highest inner products, ties by the smaller id."""
    spark, work = df.sparkSession, Scratch(df.sparkSession)
    is_query = F.col("id") % 100 == 0 if is_query is None else is_query
    numbered = whole_vectors(df, id_col, vector_col, scale).withColumn("rid", F.monotonically_increasing_id())
    numbered = work.save("numbered", numbered)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = F.greatest(F.size("x"), F.lit(1))
    asked = numbered.where(is_query).agg(F.count("*").alias("n"), F.max(width).alias("width")).first()
    if not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    few = numbered.orderBy(F.xxhash64("rid"), "rid").limit(SEEDS).toArrow()
    seeds = spark.sparkContext.broadcast(_vectors(few))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its nearest pivot, by cosine."""
        pivots = seeds.value.x[:PIVOTS]
        pivots = pivots / np.maximum(np.abs(pivots).max(axis=1, keepdims=True, initial=1.0), 1.0)
        pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
        for batch in batches:
            x = _wide(_vectors(batch).x, pivots.shape[1])
            near = (x[:, : pivots.shape[1]] @ pivots.T).argmax(axis=1) if len(x) and pivots.shape[1] else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "x", "rid", "pivot"])

    dealt = numbered.mapInArrow(placed, "id long, x array<double>, rid long, pivot int")
    # By range of (pivot, row), so a pivot with a third of all rows is dealt to many tasks.
    sharded = work.save("sharded", dealt.repartitionByRange(parts, "pivot", "rid").sortWithinPartitions("pivot", "rid").select("id", "x", "rid"))

    n_blocks = -(-asked["n"] * asked["width"] * 8 // query_bytes)
    queries = numbered.where(is_query).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n_blocks)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their k-th best score among the seeds (null if that says nothing)."""
        for batch in batches:
            own = _vectors(batch)
            best = [Best(k) for _ in own.ids]
            search_shard(own, best, seeds.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.least for b in best], pa.int64())], names=["id", "x", "rid", "least"])

    out = None
    for block in range(n_blocks):
        some = queries.where(F.col("block") == block).select("id", "x", "rid")
        some = some.repartition(min(parts, max(1, asked["n"] // n_blocks // 64)), "rid").mapInArrow(first, "id long, x array<double>, rid long, least long").toArrow()
        if not some.num_rows:
            continue
        sent = spark.sparkContext.broadcast((_vectors(some), some.column("least").to_pylist()))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, floors = sent.value
            best = [Best(k, least) for least in floors]
            held: list[pa.RecordBatch] = []
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    held.append(batch.slice(at, rows))
                    if sum(x.num_rows for x in held) >= rows:
                        search_shard(asked, best, _vectors(pa.Table.from_batches(held)))
                        held = []
            if held:
                search_shard(asked, best, _vectors(pa.Table.from_batches(held)))
            for at in range(0, len(best), 4096):
                some = range(at, min(at + 4096, len(best)))
                n = [len(best[i].found[0]) for i in some]
                cols = [np.repeat(v[at : at + 4096], n) for v in (asked.ids, asked.rows)]
                cols += [np.concatenate([best[i].found[j] for i in some]) for j in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query", "vec_id", "rid", "score"])

        found = work.save(f"found{block}", sharded.mapInArrow(search, "query_id long, query long, vec_id long, rid long, score long"))
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES, ORACLES = {"op13_topk": op13_topk}, {"op13_topk": ORACLE}
