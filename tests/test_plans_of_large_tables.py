"""What is computed and shuffled once; results are compared with SQL elsewhere."""

import hashlib
from datetime import date

from pyspark.sql import functions as F

import __spark_entry__ as entry
from factlens.functions import embed, extract

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_as_of_join_carries_what_is_asked_for(spark):
    assert "part#" not in plan(spark, "as_of_latest")


def test_words_of_a_seed_are_looked_for_once(spark):
    assert plan(spark, "seed_dedupe").count("regexp_extract_all(") == 1


def test_names_are_looked_for_in_texts_with_verbs(spark):
    assert "RLIKE" in plan(spark, "relation_frames_documents").split("Generate")[-1]
    edges = spark.createDataFrame([(1, "Tax Act requires care. x"), (2, "The Tax Act requires\ncare of it"), (3, "The Tax Actrequires care"), (4, "The Tax Act is REQUIRES care")], "id int, text string")
    assert sorted((r.id, r.object) for r in extract.relation_frames(edges, ["id"]).select("id", "object").collect()) == [(4, "care")]


def test_texts_are_dealt_once(spark):
    assert plan(spark, "hashing_embedding_sparse_documents").count("Exchange hashpartitioning") == 1
    words = ["a", "straße", "42", ""]
    for dimensions in (256, 768, 1_000_003):
        got = spark.createDataFrame([(w,) for w in words], "w string").select("w", embed.bucket(F.col("w"), dimensions).alias("b")).collect()
        assert {r.w: r.b for r in got} == {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % dimensions for w in words}


def test_adjacency_holds_asked_columns(spark, monkeypatch):
    from factlens.operators import traversal

    kept = []
    monkeypatch.setattr(traversal, "store_adjacency", lambda edges: kept.append(edges.columns) or edges)
    for name in ("stored_bfs", "stored_neighbors_2hop"):
        entry.queries()[name](spark, SF)
    assert [("evidence" in c, "chunk_id" in c) for c in kept] == [(False, False), (False, True)]


def test_sweep_joins_once_and_deals_rows_by_their_number(spark, monkeypatch):
    from factlens.plans import facts

    want = sorted(entry.queries()["temporal_density_sweep"](spark, SF).collect())
    assert plan(spark, "temporal_density_sweep").count("Scan parquet") == 2
    monkeypatch.setattr(facts, "UNDEALT", 1000)
    monkeypatch.setattr(facts, "JOINED", 1000)
    assert ", 6), REPARTITION_BY_NUM" in plan(spark, "temporal_density_sweep")
    assert sorted(entry.queries()["temporal_density_sweep"](spark, SF).collect()) == want


def test_more_parts_than_writers_send_on_only_when_tasks_are_large(spark, monkeypatch):
    from factlens.plans import facts

    monkeypatch.setattr(facts, "UNDEALT", 1000)
    monkeypatch.setattr(facts, "JOINED", 10)
    assert ", 200), REPARTITION_BY_NUM" in plan(spark, "temporal_density_sweep")
    monkeypatch.setattr(facts, "MOST_JOINED", 20)
    assert ", 300), REPARTITION_BY_NUM" in plan(spark, "temporal_density_sweep")


def test_relations_and_dates_are_read_inside_a_row(spark):
    """Each table is scanned once, and the patterns of whole dates are looked for once a text."""
    assert plan(spark, "relation_frames").count("Scan parquet") == 2
    assert "Window" not in plan(spark, "relation_frames")
    for name in ("find_dates", "relation_frames", "chunk_window"):
        assert plan(spark, name).count(r"\b\d{4}-\d{1,2}-\d{1,2}\b") == 1, name
    said = "The Tax Act sets fees and requires care. The Tax Act sets fees and requires care. A Rate Act bars entry until 2024-05-01. The Tax Act bars the."
    texts = spark.createDataFrame([(1, said), (1, "The Tax Act sets fees and requires care."), (2, ""), (3, None)], "id int, text string")
    got = extract.relation_frames(texts, ["id"]).orderBy("position", "predicate").collect()
    assert [(r.id, r.position, r.subject, r.predicate, r.object, r.valid_from) for r in got] == [
        (1, 0, "Tax Act", "requires", "care", None),
        (1, 0, "Tax Act", "sets", "fees and requires care", None),
        (1, 2, "Rate Act", "bars", "entry", date(2024, 5, 1)),
    ]
