import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factlens.functions import interval as iv
from factlens.functions.window import explorer_window, parse_window
from factlens.operators import asof, dyadic, intervals

D = date.fromisoformat


@pytest.mark.parametrize("text, as_of, start, end", [
    ("Q3 2024", None, "2024-07-01", "2024-09-30"), ("Q1-Q2 2025", None, "2025-01-01", "2025-06-30"), ("2024", None, "2024-01-01", "2024-12-31"),
    ("2024-03-01 to 2024-09-30", None, "2024-03-01", "2024-09-30"), ("January 2024 to March 2024", None, "2024-01-01", "2024-03-31"),
    ("as of Dec 31, 2023", None, "2023-12-31", "2023-12-31"), ("current quarter", "2024-05-15", "2024-04-01", "2024-06-30"),
    ("last 90 days", "2024-10-31", "2024-08-02", "2024-10-31"), ("what changed?", None, None, None), ("H1 2024", None, "2024-01-01", "2024-06-30"),
    ("2024-07-15", None, "2024-07-15", "2024-07-16"), ("as of 2024-07-15", None, "2024-07-15", "2024-07-15"), ("2024-07", None, "2024-01-01", "2024-12-31"),
    ("2024-01-01..2024-06-30", None, "2024-01-01", "2024-01-02"), ("last tax year", "2024-05-15", None, None), ("year 3000", None, None, None),
    ("previous quarter", "2024-02-10", "2023-10-01", "2023-12-31"), ("last month", "2024-03-15", "2024-02-01", "2024-02-29"), ("", None, None, None), (None, None, None, None),
    ("2024/03/01 until 2024.09.30", None, "2024-03-01", "2024-09-30"), ("Q2, 2023", None, "2023-04-01", "2023-06-30"), ("q4 to q3 2024", None, "2024-07-01", "2024-12-31"), ("Sept 2024 – May 2025", None, "2024-09-01", "2025-05-31"),
    ("on March 5 2024", None, "2024-03-05", "2024-03-05"), ("last 2 years", "2024-02-29", "2022-02-28", "2024-02-29"), ("last 3 months", "2024-05-15", "2024-02-01", "2024-05-15"), ("last quarter", "2024-05-15", "2024-01-01", "2024-03-31"),
    ("this year", "2024-05-15", "2024-01-01", "2024-12-31"), ("the past 30 days", "2024-05-15", "2024-04-15", "2024-05-15"), ("today", "2024-05-15", "2024-05-15", "2024-05-15"), ("mayor 2024", None, "2024-01-01", "2024-12-31"), ("current year 3000", "2024-05-15", None, None),
])
def test_window_words(spark, text, as_of, start, end):
    got = parse_window(text, as_of and D(as_of))
    assert got.bounds == (start and D(start), end and D(end))


def test_window_labels(spark):
    assert [parse_window(x, D("2024-05-15")).label for x in (" Q3 2024 ", "in the current quarter", "last quarter", "this year", "currently", "year 3000")] == ["Q3 2024", "current quarter", "previous quarter", "current year", "current", ""]
    with pytest.raises(ValueError):
        parse_window("2024-02-30")


def test_interval_algebra(spark):
    rows = [(None, None), ("2024-01-01", None), (None, "2024-03-31"), ("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30"), ("2024-07-01", "2025-06-30"), ("2024-01-01", "2024-12-31")]
    t = spark.createDataFrame(rows, "s string, e string").select(F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    pairs = t.join(t.select(F.col("s").alias("s2"), F.col("e").alias("e2"))).withColumn("o", iv.overlaps("s", "e", "s2", "e2")).withColumn("i", iv.intersection("s", "e", "s2", "e2")).withColumn("x", iv.intersection("s", "e", "s2", "e2", faithful=True)).collect()
    for r in pairs:
        low, high = max(r.s or date.min, r.s2 or date.min), min(r.e or date.max, r.e2 or date.max)
        assert r.o == (low <= high) and (r.i is not None) == r.o
        if r.o:
            assert (r.i.start, r.i.end) == (None if low == date.min else low, None if high == date.max else high)
        else:
            assert (r.x.start, r.x.end) == (None, None)


def test_sweep_and_bucketed_join(spark):
    t = spark.createDataFrame([("2024-01-01", "2024-06-30"), ("2024-03-01", "2024-09-30")], "s string, e string").select(F.col("s").cast("date").alias("valid_from"), F.col("e").cast("date").alias("valid_until"))
    got = sorted(tuple(r) for r in intervals.sweep(t).collect())
    assert got == [(D("2024-01-01"), D("2024-03-01"), 1), (D("2024-03-01"), D("2024-06-30"), 2), (D("2024-06-30"), D("2024-09-30"), 1)]
    base = F.to_date(F.lit("2024-01-01"))
    n = spark.range(80).select("id", F.when(F.col("id") % 9 != 0, F.date_add(base, (F.col("id") * 7 % 200).cast("int"))).alias("s"), F.when(F.col("id") % 7 != 0, F.date_add(base, (F.col("id") * 7 % 200 + F.col("id") % 40 - 3).cast("int"))).alias("e"))
    m = n.select(F.col("id").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    plain = {(r.id, r.j) for r in intervals.overlap_join(n, m, "s", "e", "s2", "e2").collect()}
    rows = [(r.id, r.j) for r in intervals.overlap_join(n, m, "s", "e", "s2", "e2", days=30, bound=("2023-01-01", "2025-12-31")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain


def test_snapshot_difference(spark):
    schema = "subject string, predicate string, object string, valid_from date, valid_until date, evidence string, edge_seq long"
    a = spark.createDataFrame([("Policy X", "requires", "A", D("2023-01-01"), D("2025-12-31"), "same", 1), ("Policy X", "permits", "B", D("2023-01-01"), None, "same", 2)], schema)
    b = spark.createDataFrame([("Policy X", "requires", "A", D("2026-01-01"), None, "updated", 1), ("Policy X", "prohibits", "C", D("2026-01-01"), None, "new", 2), ("Policy X", "permits", "B", D("2023-01-01"), None, "same", 3)], schema)
    got = {(r.bucket, r.predicate) for r in intervals.snapshot_diff(a, b, ("2023-01-01", "2025-12-31"), ("2026-01-01", "2026-12-31")).collect()}
    assert got == {("added", "prohibits"), ("changed", "requires"), ("unchanged", "permits")}


def test_explorer_windows(spark):
    assert [explorer_window(x) for x in ("Q2 2024", "2024", "2024-02", "2024-01-01..2024-06-30", "2024-07-15", "soon")] == [("2024-04-01", "2024-06-31"), ("2024-01-01", "2024-12-31"), ("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-06-30"), ("2024-07-15", "2024-07-15"), None]


def _random_intervals(spark, n, seed, names):
    rng = random.Random(seed)
    day = lambda: D("2021-01-01") + timedelta(rng.randrange(300)) if rng.random() < 0.8 else None
    rows = []
    for i in range(n):
        s = day()
        e = s + timedelta(rng.randrange(60)) if s and rng.random() < 0.6 else day()
        rows.append((i, f"k{rng.randrange(3)}", s, e))
    return rows, spark.createDataFrame(rows, f"{names[0]} int, k string, {names[1]} date, {names[2]} date")


def _met(a, b):
    return (a[2] is None or b[3] is None or a[2] <= b[3]) and (b[2] is None or a[3] is None or b[2] <= a[3])


def test_dyadic_overlap_by_brute_force(spark):
    (a, left), (b, right) = _random_intervals(spark, 120, 1, ("i", "s", "e")), _random_intervals(spark, 90, 2, ("j", "s2", "e2"))
    for on in ([], ["k"]):
        r = right if on else right.drop("k")
        pairs = [(x.i, x.j) for x in dyadic.overlap_join(left, r, "s", "e", "s2", "e2", on=on).collect()]
        want = {(x[0], y[0]) for x in a for y in b if _met(x, y) and (not on or x[1] == y[1])}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        whole = lambda x: x[2] is None or x[3] is None or x[2] <= x[3]
        counts = {x.i: x.n for x in dyadic.overlap_counts(left, r, "s", "e", "s2", "e2", on=on).collect()}
        assert counts == {x[0]: sum(whole(x) and whole(y) and _met(x, y) and (not on or x[1] == y[1]) for y in b) for x in a}
    nothing = left.limit(0)
    assert dyadic.overlap_join(nothing, right.drop("k"), "s", "e", "s2", "e2").count() == 0 and dyadic.overlap_counts(nothing, nothing, "s", "e", "s", "e").count() == 0


def test_cover_is_short(spark):
    """An interval has at most two nodes a level, and each of its days one of them among its ancestors."""
    tree = dyadic.Tree(D("2000-01-01"), D("2000-12-31"))
    rows = spark.createDataFrame([(a, b) for a in range(0, 366, 13) for b in range(a - 1, 366, 17)], "a int, b int")
    for r in rows.select("a", "b", tree.cover(F.col("a"), F.col("b")).alias("c")).collect():
        height = lambda n: tree.levels + 1 - n.bit_length()
        own = [x - (1 << tree.levels) for n in r.c for x in range(n << height(n), (n + 1) << height(n))]
        assert sorted(own) == list(range(r.a, r.b + 1)) and len(r.c) <= 2 * tree.levels


def test_as_of_latest_by_brute_force(spark):
    rng = random.Random(7)
    day = lambda: D("2022-01-01") + timedelta(rng.randrange(400)) if rng.random() < 0.95 else None
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    facts = [(key(), day(), i) for i in range(150)]
    probes = [(i, key(), day()) for i in range(200)] + [(900, "none", D("2022-05-05")), (901, "hot", D("2021-01-01"))]
    f, p = spark.createDataFrame(facts, "k string, t date, seq int"), spark.createDataFrame(probes, "id int, k string, at date")
    want = {i: max(((t, n) for k2, t, n in facts if k2 == k and t is not None and t <= at), default=(None, None))[1] if k is not None and at is not None else None for i, k, at in probes}
    for days in (1, 30, 10_000):
        got = asof.as_of_latest(p, f, "k", "at", "t", "seq", days=days).select("id", "fact.seq").collect()
        assert len(got) == len(probes) and {r.id: r.seq for r in got} == want
    assert asof.as_of_latest(p.limit(0), f, "k", "at", "t", "seq").count() == 0
