import re
from collections import Counter, defaultdict
from datetime import timedelta

from pyspark.sql import functions as F
from statements import CHUNK_WINDOWS, DATES, READ, RELATIONS, REPLIED, REPLIES, STATEMENTS, WINDOWS

import __spark_entry__ as entry
from factlens.functions import extract
from factlens.functions.text import EMBEDDING_STOPWORDS
from factlens.operators import retrieval
from factlens.plans.facts import facts

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_words_of_all_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert any(not x.isascii() for x in docs.values())
    words = {k: Counter(w for w in re.findall("[a-z0-9_']+", x.lower()) if w not in EMBEDDING_STOPWORDS) for k, x in docs.items()}
    assert {(r.doc_id, r.term, r.tf) for r in rows(spark, "term_frequency_documents")} == {(k, w, n) for k, c in words.items() for w, n in c.items()}
    assert {(r.doc_id, r.tokens, r.distinct_tokens) for r in rows(spark, "word_tokens_documents")} == {(k, c.total(), len(c)) for k, c in words.items() if c}
    assert {r.term for r in rows(spark, "hash_bucket_documents")} == {w for c in words.values() for w in c}
    assert {r.doc_id for r in rows(spark, "hashing_embedding_sparse_documents")} == {k for k, c in words.items() if c}
    sets = {k: {w for w in re.findall("[a-z0-9]+", x.lower()) if len(w) > 2} for k, x in docs.items()}
    want = {k: round(len(a & sets[k + 1]) / len(a | sets[k + 1]) if a and sets[k + 1] else 0, 6) for k, a in sets.items() if k + 1 in sets}
    assert {r.doc_id: round(r.overlap, 6) for r in rows(spark, "jaccard_pairs_documents")} == want
    named = rows(spark, "candidate_entities_documents")
    assert {r.doc_id for r in named} - {k for k, x in docs.items() if x.isascii()}
    assert len(rows(spark, "canonical_entity_documents")) == len({re.sub("^(the|an?)\\s+", "", r.name.strip(" "), flags=re.I).lower() for r in named})


def test_intervals_of_all_facts(spark):
    all_facts = facts(spark, SF).select("subject", "chunk_id", "valid_from", "valid_until").collect()
    starts = sorted(r.s for r in spark.read.parquet(f"{SF}/orders.parquet").selectExpr("CAST(o_orderdate AS DATE) AS s").collect() if r.s)
    assert any(r.valid_until is None for r in all_facts)
    shown = Counter((r.chunk_id, r.validity) for r in rows(spark, "interval_rendered_facts"))
    assert shown == Counter((r.chunk_id, f"{r.valid_from} → {r.valid_until or '…'}") for r in all_facts)
    pairs, met = Counter(), defaultdict(set)
    for r in all_facts:
        hit = [i for i, s in enumerate(starts) if (r.valid_until is None or s <= r.valid_until) and s + timedelta(10) >= r.valid_from]
        pairs[r.subject] += len(hit)
        met[r.subject].update(hit)
    got = {r.subject: (r.pairs, r.orders) for r in rows(spark, "interval_overlap_counts")}
    assert got == {k: (n, len(met[k])) for k, n in pairs.items() if n}


def plain(rows):
    return sorted((tuple(str(v) if hasattr(v, "year") else v for v in r) for r in rows), key=str)


def test_extraction_over_documents(spark, tmp_path):
    """Statements as documents give what is in them, and the tables' documents are all read."""
    own = list(STATEMENTS.items()) + [(x, x) for x in WINDOWS]
    spark.createDataFrame(own, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, want in (("find_dates", DATES), ("chunk_window", CHUNK_WINDOWS), ("relation_frames", RELATIONS), ("window_grammar", READ)):
        ids = {x[0] for x in want}
        got = [r for r in entry.queries()[f"{name}_documents"](spark, str(tmp_path)).collect() if r.doc_id in ids]
        assert plain(got) == plain(want), name
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows(spark, "chunk_window_documents")} == ids == {r.doc_id for r in rows(spark, "window_grammar_documents")}
    assert {r.doc_id for r in rows(spark, "find_dates_documents")} <= ids and {r.doc_id for r in rows(spark, "relation_frames_documents")} <= ids


def test_replies_seeds_and_questions(spark):
    replies = spark.createDataFrame(REPLIES, "id string, reply string")
    assert plain(extract.reply_relations(replies, ["id"]).select("id", "subject", "predicate", "object", "valid_from", "valid_until", "start_label").collect()) == plain(REPLIED)
    assert [(r.id, r.name, r.type, r.confidence) for r in extract.reply_entities(replies, ["id"]).collect()] == [("plain", "EU", "Jurisdiction", 0.5)]
    names = F.array(*map(F.lit, ["Data Transfer Policy", "The Data Transfer Policy", "Personal Data", "EU", "EU", "Tax Reform Act", "Reform Act", "Personal Data Policy"]))
    assert spark.range(1).select(retrieval.distinct_seeds(names).alias("a")).first().a == ["Data Transfer Policy", "Personal Data", "EU", "EU", "Tax Reform Act"]
    nodes = spark.createDataFrame([(x,) for x in ("The Data Transfer Policy", "Transfer Policy of Data", "Tax Reform Act", "EU", "Policy", "Corporate Finance Act")], "name string")
    asked = nodes.where(retrieval.question_names_node(F.col("name"), F.lit("What does the data transfer policy say about a tax reform?")))
    assert [r.name for r in asked.collect()] == ["The Data Transfer Policy", "Transfer Policy of Data", "Tax Reform Act"]
