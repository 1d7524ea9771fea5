"""Plans and results of what failed on larger tables."""

from collections import defaultdict
from datetime import date, timedelta

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factlens.functions import extract
from factlens.operators import dyadic

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_few_rows_need_no_nodes(spark, monkeypatch):
    """Neither form broadcasts an exploded side, and both give the same pairs."""
    day = date(2024, 1, 1)
    left = [(k, i, day + timedelta(7 * i % 90), None if i % 3 == 0 else day + timedelta(7 * i % 90 + i)) for k in "abc" for i in range(20)]
    right = [(k, i, day + timedelta(11 * i % 90), day + timedelta(11 * i % 90 + 5)) for k, n in (("a", 2), ("b", 9), ("d", 9)) for i in range(n)]
    a = spark.createDataFrame(left, "k string, i int, ls date, le date")
    b = spark.createDataFrame(right, "k string, j int, rs date, re date")
    want = sorted((k, i, j) for k, i, s, e in left for k2, j, s2, e2 in right if k == k2 and s <= e2 and (e is None or s2 <= e))
    for most in (1000, 4, 0):
        monkeypatch.setattr(dyadic, "MOST_OF_A_KEY", most)
        pairs = dyadic.overlap_join(a, b, "ls", "le", "rs", "re", on=["k"])
        assert sorted((r.k, r.i, r.j) for r in pairs.select("k", "i", "j").collect()) == want, most
    pairs = dyadic.overlap_join(a.select("i", "ls", "le"), b.select("j", "rs", "re"), "ls", "le", "rs", "re")
    assert "BroadcastHashJoin" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
    monkeypatch.setattr(dyadic, "MOST_OF_A_KEY", 1000)
    assert "Generate" not in plan(entry.queries()["interval_overlap_own"](spark, SF))


def test_a_reply_is_parsed_once(spark):
    for name in ("llm_json_salvage", "llm_reply_entities"):
        assert plan(entry.queries()[name](spark, SF)).count("from_json(") == 1, name
    replies = ['```json\n{"entities": [{"name": "A"}]}\n```', 'So: {"entities": [{"name": "B"}]} and {', "", None, '{"entities": []}', "[1", '{"entities": null}']
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    assert [(r.i, r.name) for r in extract.reply_entities(rows, ["i"]).orderBy("i").collect()] == [(0, "A"), (1, "B")]
    rows = spark.createDataFrame([(0, 'So: {"entities": [{"name": "B"}]} Bye'), (1, "x {} y")], "i int, reply string")
    assert [(r.i, r.j) for r in rows.select("i", extract.reply_json("reply").alias("j")).orderBy("i").collect()] == [(0, '{"entities": [{"name": "B"}]}'), (1, "{}")]


def test_overlaps_are_counted_without_pairs(spark, tmp_path):
    """Orders that repeat with other days, with equal days, or without a day or key."""
    for name in ("lineitem", "orders"):
        duckdb.sql(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    duckdb.sql("INSERT INTO orders SELECT * REPLACE (o_orderdate + INTERVAL 3 DAY AS o_orderdate) FROM orders WHERE o_orderkey % 3 = 0")
    duckdb.sql("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 5 = 0")
    duckdb.sql("INSERT INTO orders SELECT * REPLACE (NULL AS o_orderdate) FROM orders WHERE o_orderkey % 7 = 0")
    duckdb.sql("INSERT INTO orders SELECT * REPLACE (NULL AS o_orderkey) FROM orders WHERE o_orderkey % 11 = 0")
    want = sorted(duckdb.sql(entry.oracle_sql()["interval_overlap_join"]).fetchall())
    for name in ("lineitem", "orders"):
        duckdb.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    found = entry.queries()["interval_overlap_join"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.select("subject", "pairs", "orders").collect()) == want and len(want) > 20
