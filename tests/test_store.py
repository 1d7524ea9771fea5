import random
import shutil
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from statements import STATEMENTS

from factlens.engine import Engine
from factlens.functions import interval as iv
from factlens.operators import graph, traversal
from factlens.sources.store import EDGES, Store, write_by_validity

PAGES = "doc_id string, page int, text string"


def ingest(engine, **texts):
    engine.ingest(engine.store.spark.createDataFrame([(k, 1, v) for k, v in texts.items()], PAGES))


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def facts(df):
    return sorted((r.subject, r.predicate, r.object) for r in df.collect())


def scanned(df):
    """Rows that the plan's scans gave on."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    for i in range(leaves.length()):
        node = leaves.apply(i)
        if "QueryStage" in node.getClass().getName():
            node = node.plan().collectLeaves().apply(0)
        rows += node.metrics().apply("numOutputRows").value() if node.metrics().contains("numOutputRows") else 0
    return rows


def test_deletes_show_after_questions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), dimensions=16)
    ingest(engine, a=STATEMENTS["a"], b=STATEMENTS["b"])
    before = cached(spark)
    assert engine.neighbors("Tax Reform Act", 2).count() == 2 and engine.neighbors("Data Transfer Policy", 3).count() == 2
    assert engine.query("What does the Data Transfer Policy permit in Q3 2024?").count() == 1
    engine.delete_document("a")
    assert facts(engine.store.edges()) == facts(engine.neighbors("Tax Reform Act", 2)) and len(facts(engine.store.edges())) == 2
    assert engine.neighbors("Data Transfer Policy", 2).count() == 0
    ingest(engine, b="Nothing is dated here.", c=STATEMENTS["b"])
    assert {r.doc_id for r in engine.neighbors("Tax Reform Act", 2).collect()} == {"c"}
    assert cached(spark) == before


def test_statistics_without_edges(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), dimensions=16)
    same = lambda: engine.stats().first() == graph.stats(engine.store.edges(), graph.merge_nodes(engine.store.mentions(), engine.store.edges())).first()
    ingest(engine, a=STATEMENTS["a"], b=STATEMENTS["b"])
    assert same() and engine.stats().first().edge_count == 5
    ingest(engine, a=STATEMENTS["b"], c="Nothing is dated here.")
    assert same() and engine.stats().first().edge_count == 4
    engine.delete_document("b")
    assert same()
    engine.store.compact()
    assert same()
    want = engine.stats().first()
    for name in ("edges", "adjacency", "chunks"):
        shutil.rmtree(tmp_path / "s" / name)
    assert engine.stats().first() == want and want.edge_count == 2 and want.doc_count == 1


def test_writers_and_readers_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    engine = Engine(spark, store.path, dimensions=16)
    ingest(engine, a=STATEMENTS["a"])
    numbers, others = [], [Store(spark, store.path) for _ in range(4)]
    threads = [threading.Thread(target=lambda s=s: numbers.extend([s.reserve(), s.reserve()])) for s in others]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(numbers)) == 8
    threads = [threading.Thread(target=lambda s=s, n=n: s.commit(n, [])) for s, n in zip(others, numbers, strict=False)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {str(n) for n in numbers[:4]} <= store._batches().keys()
    # A batch that is never committed leaves no trace, and a reader keeps what it read.
    store.put("edges", store.edges(), store.reserve())
    reader = store.edges()
    assert reader.count() == 3
    ingest(engine, a=STATEMENTS["b"])
    store.compact()
    assert len(facts(reader)) == 3 and len(facts(store.edges())) == 2
    assert store.vacuum() == 0 and len(facts(reader)) == 3
    assert store.vacuum(0) > 0 and len(facts(store.edges())) == 2


def test_versions_outlive_compaction(spark, tmp_path):
    """Who reserved later counts, even if the batches are committed the other way round and compacted between."""
    engine = Engine(spark, str(tmp_path / "s"), dimensions=16)
    store, late = engine.store, Engine(spark, str(tmp_path / "s"), dimensions=16)
    ingest(engine, a=STATEMENTS["d"], b=STATEMENTS["d"])
    slow = store.reserve()
    ingest(engine, b=STATEMENTS["b"])
    store.compact()
    late.store.reserve = lambda: slow
    ingest(late, a=STATEMENTS["a"], b=STATEMENTS["a"])
    assert {(r.doc_id, r.predicate) for r in store.edges().collect()} == {("a", "requires"), ("a", "permits"), ("a", "governs"), ("b", "imposes"), ("b", "amends")}
    live = store._batches()
    store.compact()
    with pytest.raises(RuntimeError, match="replaced"):
        store.commit(store.reserve(), [], [*live])


def random_edges(spark, n=400, names=60):
    rng = random.Random(3)
    day = lambda: date(2020, 1, 1) + timedelta(rng.randrange(1500)) if rng.random() < 0.7 else None
    name = lambda: rng.choice(["The ", "", "the "]) + f"Node {min(rng.randrange(names), rng.randrange(names))}"
    rows = [(name(), rng.choice("pq"), name(), day(), day(), None, None, f"d{i % 7}", f"c{i}", "e", 0.5, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, EDGES)


def brute(rows, start, hops, key, window):
    ends = lambda r: {key(r[0]), key(r[2])}
    rows = [r for r in rows if (r[4] is None or r[4] >= window[0]) and (r[3] is None or r[3] <= window[1])]
    dist = {key(x): 0 for x in start}
    for hop in range(1, hops):
        for n in {e for r in rows if any(dist.get(x) == hop - 1 for x in ends(r)) for e in ends(r)}:
            dist.setdefault(n, hop)
    return [(r, d + 1) for r in rows for d in {dist[x] for x in ends(r) if x in dist} if d < hops]


@pytest.mark.parametrize("limits", [{}, {"MAX_CONSTANTS": 0}, {"MAX_LOCAL": 1, "MAX_BROADCAST": 3}])
def test_traversals_by_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(traversal, k, v)
    rows, edges = random_edges(spark)
    window = (date(2021, 1, 1), date(2022, 6, 30))
    canonical = lambda x: x.removeprefix("The ").removeprefix("the ").lower()
    for source in (edges, traversal.store_adjacency(edges)):
        for hops in (1, 2, 3):
            want = brute(rows, ["Node 3"], hops, str, window)
            assert sorted((r.edge_seq, r.hop) for r in graph.neighbors(source, "Node 3", hops, window=window, bag=True).collect()) == sorted((r[11], h) for r, h in want)
            least = {r[11]: min(h for s, h in want if s is r) for r, _ in want}
            assert {r.edge_seq: r.hop for r in graph.neighbors(source, " Node  3", hops, window=window).collect()} == least
        seeds = spark.createDataFrame([("The Node 5",), ("node 59",), (None,)], "name string")
        best = {}
        for r, h in brute(rows, ["Node 5", "node 59"], 2, canonical, window):
            best[r[:3]] = min(best.get(r[:3], (9, 0)), (h, r[11]))
        assert {(r.subject, r.predicate, r.object): (r.hop, r.edge_seq) for r in graph.time_sliced_bfs(source, seeds, 2, window, most=None).collect()} == best


def test_a_hop_reads_its_folders_only(spark, tmp_path):
    _, edges = random_edges(spark)
    rows = traversal.both_directions(edges, F.col("edge_seq"))
    traversal.write_adjacency(rows, str(tmp_path / "adj"))
    stored = traversal.Adjacency(spark.read.schema(rows.schema).parquet(str(tmp_path / "adj")), edges.columns)
    want = sorted(map(tuple, graph.neighbors(stored, "Node 3").collect()))
    (own,) = {r.bucket for r in rows.where("end = 'Node 3'").select("bucket").distinct().collect()}
    found = graph.neighbors(stored, "Node 3", bag=True)
    plan = found._jdf.queryExecution().toString()
    assert f"bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(end), EqualTo(end,Node 3)]" in plan  # noqa: F541
    for folder in (tmp_path / "adj").glob("bucket=*"):
        if folder.name != f"bucket={own}":
            shutil.rmtree(folder)
    again = traversal.Adjacency(spark.read.schema(rows.schema).parquet(str(tmp_path / "adj")), edges.columns)
    assert want and sorted(map(tuple, graph.neighbors(again, "Node 3").collect())) == want


def test_scans_skip_by_validity(spark, tmp_path):
    day = lambda n: F.date_add(F.to_date(F.lit("2000-01-01")), n.cast("int"))
    n = F.col("id")
    rows = spark.range(60_000).select(n.cast("string").alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"), day(n * 7919 % 6000).alias("valid_from"), F.when(n % 3 > 0, day(n * 7919 % 6000 + n % 40)).alias("valid_until"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in EDGES.fields[5:11]], n.alias("edge_seq"))
    write_by_validity(rows.repartition(6), str(tmp_path / "by"))
    rows.repartition(6).write.parquet(str(tmp_path / "plain"))
    stored = spark.read.parquet(str(tmp_path / "by"))
    read = {}
    for name, window in (("month", ("2003-05-01", "2003-05-31")), ("years", ("2003-05-01", "2012-05-31")), ("first", ("2000-01-01", "2000-02-01"))):
        found = graph.edges_valid(stored, window=window)
        read[name] = scanned(found)
        assert sorted(r.edge_seq for r in found.collect()) == sorted(r.edge_seq for r in rows.where(iv.valid_within("valid_from", "valid_until", *window)).collect())
    assert scanned(graph.edges_valid(spark.read.parquet(str(tmp_path / "plain")), window=("2000-01-01", "2000-02-01"))) == 60_000
    assert read["first"] < read["month"] < read["years"] <= 60_000 and read["first"] < 30_000
