import json
import time
from datetime import date

import pytest
from statements import STATEMENTS

from factlens.engine import Engine
from factlens.functions.text import short_hash
from factlens.operators import graph
from factlens.operators.chunking import chunk_documents
from factlens.operators.extraction import extract_chunks
from factlens.sources import pages as sources
from factlens.sources.state import latest, overlay, synced
from factlens.sources.store import write_graphml, write_json
from factlens.streaming.ingest import ingest, ingest_stream

PAGES = "doc_id string, page int, text string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, str(tmp_path_factory.mktemp("store")), dimensions=64, size=200, overlap=30)
    out.ingest(spark.createDataFrame([("doc-a", 1, STATEMENTS["a"]), ("doc-b", 1, STATEMENTS["b"])], PAGES))
    return out


def predicates(df):
    return {r.predicate for r in df.collect()}


def test_facts_and_windows(engine):
    assert predicates(engine.store.edges()) == {"requires", "permits", "governs", "imposes", "amends"}
    assert predicates(engine.snapshot(window="Q3 2024")[0]) == {"permits", "governs", "imposes"}
    diff = {(r.bucket, r.predicate) for r in engine.graph_diff("Q1 2022", "Q4 2024").collect()}
    assert diff == {("added", "permits"), ("added", "imposes"), ("added", "amends"), ("removed", "requires"), ("unchanged", "governs")}
    assert engine.stats().first().edge_count == 5 and engine.health().first().asDict()["edges"] == 5
    assert [r.predicate for r in engine.evolution("Data Transfer Policy").collect()] == ["requires", "permits"]
    assert predicates(engine.neighbors("Tax Reform Act", 2)) == {"imposes", "amends"}


def test_questions(engine):
    context = engine.retrieve("What does the Data Transfer Policy permit in Q3 2024?")
    assert str(context.window.start) == "2024-07-01"
    assert any("Standard Contractual Clauses" in r.text for r in context.hits.collect())
    assert "permits" in predicates(context.edges) and "requires" not in predicates(context.edges)
    said = engine.query("What does the Data Transfer Policy permit in Q3 2024?").first()
    assert said.engine == "extractive" and "--[permits]-->" in said.answer
    assert context.trace[0] == f"parsed window from question: '{context.window.label}'" and context.trace[1] == "temporal filter applied: [2024-07-01 → 2024-09-30]"
    assert context.trace[2].startswith("vector search: 2 chunk hits (top_k=6") and context.trace[-1].startswith(f"graph lens: {context.edges.count()} interval-validated facts via ")
    assert engine.retrieve("zzz").trace[0] == "no temporal filter (open window)"
    for reply, engine_, want in (('```json\n{"answer": " yes [v0] "}\n```', "model", "yes [v0]"), ("I don't know", "extractive", None), ('{"answer": ""}', "extractive", None)):
        got = engine.query("x", load=lambda reply=reply: lambda prompt: reply).first()
        assert got.engine == engine_ and (want is None or got.answer == want)
    assert engine.query("What is in Q3 2024?", load=lambda: lambda prompt: json.dumps({"answer": prompt})).first().answer.split("\n")[1:3] == ["Question: What is in Q3 2024?", f"Window: {engine.retrieve('What is in Q3 2024?').window.label}"]
    assert engine.query("x", load=lambda: lambda prompt: 1 // 0).first().engine == "extractive"
    diff, text = engine.compare("Data Transfer Policy", "Q1 2022", "Q4 2024")
    assert "Comparing “Q1 2022” vs “Q4 2024”:" in text.first().narrative and "removed" in {r.bucket for r in diff.collect()}


def test_again_and_away(engine, spark, tmp_path):
    before = engine.store.count()
    engine.ingest(spark.createDataFrame([("doc-a", 1, STATEMENTS["a"])], PAGES))
    assert engine.store.count() == before and [r.doc_id for r in engine.store.doc_ids().collect()] == ["doc-a", "doc-b"]
    write_json(engine.store.edges(), str(tmp_path / "json"))
    write_graphml(engine.store.edges(), engine.store.nodes(), str(tmp_path / "gml"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    text = "".join(p.read_text() for p in sorted((tmp_path / "gml").glob("part-*")))
    assert text.startswith("<?xml") and text.count("<edge ") == 5 and text.rstrip().endswith("</graphml>")
    with pytest.raises(ValueError, match="widths"):
        Engine(spark, engine.store.path, dimensions=32).ingest(spark.createDataFrame([("doc-c", 1, "Some Text here.")], PAGES))
    engine.delete_document("doc-a")
    assert [r.doc_id for r in engine.store.doc_ids().collect()] == ["doc-b"]
    assert predicates(engine.store.edges()) == {"imposes", "amends"}


def test_new_versions_replace_old_ones(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), dimensions=16)
    engine.ingest(spark.createDataFrame([("a", 1, STATEMENTS["a"]), ("b", 1, STATEMENTS["b"])], PAGES))
    assert engine.store.edges().count() == 5
    engine.ingest(spark.createDataFrame([("a", 1, "Nothing is dated here."), ("b", 1, "  ")], PAGES))
    assert engine.store.edges().count() == 0 and [r.doc_id for r in engine.store.doc_ids().collect()] == ["a"]
    states = {r.doc_id: (r.status, r.error, r.chunk_count, r.relation_count) for r in engine.store.states().collect()}
    assert states == {"a": ("indexed", None, 1, 0), "b": ("failed", "no text to extract", 0, 0)}
    engine.ingest(spark.createDataFrame([("b", 1, STATEMENTS["b"]), ("c", 1, STATEMENTS["a"])], PAGES))
    seqs = [(r.edge_seq, r.doc_id) for r in engine.store.edges().orderBy("edge_seq").collect()]
    assert len({x for x, _ in seqs}) == 5 and [d for _, d in seqs] == ["b", "b", "c", "c", "c"]
    before = {tuple(r) for r in engine.store.edges().collect()}
    engine.delete_document("c")
    assert {r.doc_id for r in engine.store.edges().collect()} == {"b"} and "Data Transfer Policy" not in {r.name for r in engine.store.nodes().collect()}
    engine.store.compact()
    assert {tuple(r) for r in engine.store.edges().collect()} == {r for r in before if r[7] == "b"}
    assert engine.store.vacuum(0) == 4 and len(list((tmp_path / "store" / "chunks").glob("batch=*"))) == 1
    assert {tuple(r) for r in engine.store.edges().collect()} == {r for r in before if r[7] == "b"}


def test_stream(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), dimensions=16)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": "a", "page": 1, "text": STATEMENTS["a"]}))
    for name, there in (("b", ["a"]), ("c", ["a", "b"])):
        ingest_stream(spark, engine.store, str(tmp_path / "in"), str(tmp_path / "checkpoint"), dimensions=16).awaitTermination()
        assert [r.doc_id for r in engine.store.doc_ids().collect()] == there
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"doc_id": name, "page": 1, "text": STATEMENTS["b"]}))


def test_stream_puts_documents_together(spark, tmp_path):
    """Pages of several micro-batches make one document, a replayed micro-batch changes nothing, and a timeout gives up waiting."""
    engine, folder = Engine(spark, str(tmp_path / "store"), dimensions=16), tmp_path / "in"
    folder.mkdir()
    first, second, third = (x.strip() + "." for x in STATEMENTS["a"].rstrip(".").split(". "))

    def arrive(name, *rows, **options):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "page", "text", "pages"), r, strict=False))) for r in rows))
        ingest_stream(spark, engine.store, str(folder), str(tmp_path / "checkpoint"), dimensions=16, **options).awaitTermination()
        return {k: {r.predicate for r in engine.store.edges().where(f"doc_id = '{k}'").collect()} for k in "ab"}

    assert arrive("1", ("a", 1, first, 2), (None, 1, "x", 1), ("b", 1, first)) == {"a": set(), "b": {"requires"}}
    assert arrive("2", ("b", 2, second)) == {"a": set(), "b": {"requires", "permits"}}
    assert arrive("3", ("a", 2, third)) == {"a": {"requires", "governs"}, "b": {"requires", "permits"}}
    batches = engine.store._batches()
    assert not ingest(engine.store, spark.createDataFrame([("a", 1, second)], PAGES), dimensions=16, source=(str(tmp_path / "checkpoint"), 0))
    assert engine.store._batches() == batches
    engine.delete_document("a")
    arrive("4", ("a", 9, second, 12), timeout_ms=1)
    time.sleep(0.1)
    assert arrive("5", ("c", 1, "Nothing.", 1), timeout_ms=1)["a"] == {"requires", "permits", "governs"}


def test_models_and_rules(spark, tmp_path):
    """A model that fails on every third document leaves these to the rules; the others have what it says."""
    engine = Engine(spark, str(tmp_path / "store"), dimensions=16)

    def load():
        def model(prompt):
            n = int(prompt.split("Document d")[1].split(",")[0])
            if n % 3 == 0:
                raise RuntimeError("no luck")
            if n % 3 == 1:
                return "Well: " + json.dumps({"entities": [{"name": f"Model {n}", "aliases": ["M"]}], "relations": [{"subject": f"Model {n}", "predicate": "sets", "object": "Rules", "validity": {"start": "2020-01-01", "end": "none"}}], "chunk_temporal": {"start": "2020-01-01", "end": "2020-12-31"}})
            return '{"entities": [], "relations": []}' if n == 2 else "nothing at all"

        return model

    engine.ingest(spark.createDataFrame([(f"d{n}", 1, STATEMENTS["b"]) for n in range(9)], PAGES), load)
    found = {}
    for r in engine.store.edges().collect():
        found.setdefault(r.doc_id, set()).add((r.subject, r.predicate, str(r.valid_from)))
    ruled = {("Tax Reform Act", "imposes", "2023-01-01"), ("Corporate Finance Act", "amends", "2024-10-01")}
    assert found == {f"d{n}": {(f"Model {n}", "sets", "2020-01-01")} if n % 3 == 1 else ruled for n in range(9)}
    chunks = {r.doc_id: (r.entities, str(r.start), str(r.end), r.start_label) for r in engine.store.chunks().collect()}
    assert chunks["d1"] == (["Model 1"], "2020-01-01", "2020-12-31", "2020-01-01") and chunks["d0"][1:3] == ("2023-01-01", "2025-12-31")
    assert {(r.name, r.type, tuple(r.aliases)) for r in engine.store.nodes().where("name LIKE 'Model%'").collect()} == {(f"Model {n}", "Other", ("M",)) for n in (1, 4, 7)}
    text = spark.createDataFrame([("d3", "c3", STATEMENTS["b"]), ("d4", "c4", ""), ("d5", "c5", None)], "doc_id string, chunk_id string, text string")
    engines = {r.chunk_id: (r.engine, r.error) for r in extract_chunks(text, load).engines.collect()}
    assert engines == {"c3": ("rules", "RuntimeError: no luck"), "c4": ("model", None), "c5": ("rules", None)}


def test_graph(spark):
    edges = spark.createDataFrame([
        ("Data Transfer Policy", "governs", "Data Processor", date(2024, 1, 1), date(2025, 12, 31), "1 Jan 2024", "31 Dec 2025", "d", "c1", "e", 0.5, 1),
        ("EU", "amends", "Data  Transfer Policy ", date(2025, 3, 1), None, None, None, "d", "c1", "e", 0.5, 2),
        ("", "amends", "x", None, None, None, None, "d", "c1", "e", 0.5, 3),
    ], "subject string, predicate string, object string, valid_from date, valid_until date, start_label string, end_label string, doc_id string, chunk_id string, evidence string, confidence double, edge_seq long")
    kept = graph.upsert_edges(None, edges)
    mentions = spark.createDataFrame([("Data Transfer Policy", "Regulation", None, "d", 1), ("EU", "Jurisdiction", None, "d", 2)], "name string, type string, aliases array<string>, doc_id string, seq long")
    nodes = graph.merge_nodes(mentions, kept)
    assert {(r.name, r.type) for r in nodes.collect()} == {("Data Transfer Policy", "Regulation"), ("EU", "Jurisdiction"), ("Data Processor", "Other")}
    assert predicates(graph.edges_valid(kept, at="2024-06-01")) == {"governs"}
    assert predicates(graph.edges_valid(kept, window=("2025-06-01", "2025-12-31"))) == {"governs", "amends"}
    s = graph.stats(kept, nodes).first()
    assert (s.edge_count, s.node_count, s.validated_edges, s.open_ended_edges, str(s.earliest), str(s.latest)) == (2, 3, 2, 1, "2024-01-01", "2025-12-31")
    left, rest = graph.remove_document(kept, nodes, "d")
    assert left.count() == rest.count() == 0
    assert graph.edge_model(kept).columns[3:5] == ["start", "end"]


def test_chunks(spark):
    text = "Regulation 10/23 defines new thresholds for cross-border data transfers. " * 60
    pages = spark.createDataFrame([("a", 1, "Section A.\n\nThe first policy statement covers cross-border flows."), ("a", 2, "Section B. The second statement sets limits for Q3 2024."), ("b", 1, text), ("c", 1, " ")], PAGES)
    a = chunk_documents(pages.where("doc_id = 'a'"), 20, 5).orderBy("index").collect()
    assert len(a) >= 2 and "Section A" in a[0].text and a[0].chunk_id == "a:c00000" and a[-1].page_end == 2
    b = chunk_documents(pages.where("doc_id = 'b'"), 40, 18).orderBy("index").collect()
    assert len(b) > 1 and set(b[0].text.split()) & set(b[1].text.split())
    assert chunk_documents(pages.where("doc_id = 'c'")).count() == 0
    assert {r.doc_id for r in sources.failed_documents(pages, chunk_documents(pages)).collect()} == {"c"}


def test_node_keys(spark):
    names = ["", "EU", "Data Transfer Policy", "Zoë — 字 😀", "x" * 300]

    def plain(text):
        h, raw = 2166136261, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h ^= int.from_bytes(raw[i : i + 2], "little")
            h = int(float(h - (1 << 32) if h >= 1 << 31 else h) * 16777619.0) % (1 << 32)
        return f"n{h:08x}"

    rows = spark.createDataFrame([(x,) for x in names], "name string").select("name", short_hash("name").alias("k"), short_hash("name", 4).alias("s")).collect()
    assert all(r.k == plain(r.name) and r.s == r.k[:5] for r in rows)


def test_sources_and_states(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "y.PDF").write_bytes(b"\xff")
    (tmp_path / "z.txt").write_text("p1\fp2")
    files = sources.uploads(spark, str(tmp_path))
    got = {(r.doc_id, r.page, r.text, r.error is not None) for r in sources.pages_from_files(files, lambda b: b.decode().split("\f")).collect()}
    assert got == {("x.pdf", 1, "one", False), ("x.pdf", 2, "two", False), ("y.PDF", None, None, True)}
    assert {(r.page, r.text) for r in sources.pages_from_text(spark, str(tmp_path / "z.txt")).collect()} == {(1, "p1"), (2, "p2")}
    states = spark.createDataFrame([("a", "queued", None, 0.1, "1", "1"), ("a", "indexed", None, 1.0, "1", "2"), ("b", "failed", "e", 0.2, "3", "3")], "id string, status string, error string, progress double, created_at string, updated_at string")
    last = latest(states)
    assert [(r.id, r.status) for r in last.collect()] == [("b", "failed"), ("a", "indexed")]
    new = spark.createDataFrame([("a", "failed")], "id string, status string")
    assert {(r.id, r.status, r.progress) for r in overlay(last, new).collect()} == {("a", "failed", 1.0), ("b", "failed", 0.2)}
    assert {(r.id, r.status) for r in synced(last, last.where("id = 'a'")).collect()} == {("a", "indexed"), ("b", "failed")}
