import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm.max_score import ORACLE, Best, Vectors, op13_topk, search_shard, top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=10, scale=1024, asked=lambda i: i % 100 == 0):
    own = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for n, (i, q) in enumerate(own):
        if asked(i):
            score = lambda x: min(max(sum(a * b for a, b in zip(q, x, strict=False)), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
            found = sorted((-score(x), j) for m, (j, x) in enumerate(own) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_by_brute_force(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(5)]
    rows = [(i * 5, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(700 * 100 + i, rows[0][1]) for i in range(150)]  # ties far beyond k
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS x", "'r' AS rid", "3 AS score").repartition(4)
    want = brute(rows)
    for options in ({}, {"rows": 40}, {"rows": 7, "query_bytes": 2000}):
        assert got(top_k(docs, **options)) == want
    assert got(top_k(docs, F.col("id") < 20, k=3)) == brute(rows, 3, asked=lambda i: i < 20)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [0.5]), (300, []), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [-1.0, -1.0, 3.0]), (6, [-0.0001, 0.0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(top_k(docs)) == brute(rows)
    assert top_k(docs.limit(0)).count() == 0 and top_k(docs.where("vec_id = 5")).count() == 0
    assert top_k(docs.where("vec_id = 300")).count() == 0
    assert got(top_k(docs, F.col("id") == 5, k=2)) == brute(rows, 2, asked=lambda i: i == 5)


def test_large_values(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e3, -1e9, 1e12, 1e-5, 3e5]) * rng.random() for _ in range(4)]) for i in range(60)] + [(100, [1e300, -1e300]), (200, [-1e38, 1.0]), (300, [2.0**40 + 0.25, 1.0])]
    assert got(top_k(spark.createDataFrame(rows, SCHEMA), rows=16)) == brute(rows)


def test_thresholds_spare_scores():
    """With a threshold most rows of unlike shards aren't scored, and none that counts is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (20, 64))
    x = np.floor(centres[np.arange(4000) // 200] + rng.normal(0, 60, (4000, 64)))
    ids = np.arange(4000)
    asked = Vectors(x[:40], ids[:40], ids[:40])
    best, scored = [Best(10) for _ in range(40)], 0
    for at in range(0, 4000, 400):
        scored += search_shard(asked, best, Vectors(x[at : at + 400], ids[at : at + 400], ids[at : at + 400]))
    assert scored < 0.2 * 40 * 4000
    for i, b in enumerate(best):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)).tolist() if j != i][:10]
        assert b.found[1].tolist() == order and b.found[0].tolist() == s[order].tolist()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    assert got(op13_topk(spark, f"/root/testdata/{sf}")) == sorted(db.execute(ORACLE).fetchall())
