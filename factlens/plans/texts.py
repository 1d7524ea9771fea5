"""Queries over texts, windows and vectors, with their oracle SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions import embed, extract, text, window
from factlens.operators import answers, chunking, nearest, retrieval
from factlens.plans.facts import FACTS, facts, table

#: The day on which windows in documents are read.
AS_OF = date(2024, 5, 15)


def _english(spark: SparkSession, sf: str) -> DataFrame:
    """English documents in ASCII: other letters end words in one engine's patterns and not in the other's."""
    return table(spark, sf, "documents").where("lang = 'en' AND octet_length(text) = length(text)").select("doc_id", "text")


def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean("text")).alias("clean_md5"), F.length(text.clean("text")).alias("n"))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


def paragraph_split(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id"), F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraphs(pages).select("doc_id", "position", F.md5("text").alias("text_md5"), "fresh")


def chunk_documents(spark, sf):
    """Lines as paragraphs, small chunks."""
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_documents(pages, 200, 40).select("doc_id", "chunk_id", "index", F.md5("text").alias("text_md5"), "page_start", "char_start", "char_end")


def word_tokens(spark, sf):
    return _english(spark, sf).select("doc_id", F.explode(text.word_tokens("text")).alias("w")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("w").alias("distinct_tokens"))


def term_frequency(spark, sf):
    return embed.term_frequencies(_english(spark, sf), ["doc_id"]).where("tf >= 3")


def hash_bucket(spark, sf):
    words = _english(spark, sf).select(F.explode(text.word_tokens("text")).alias("term")).distinct()
    return words.select("term", embed.bucket(F.col("term")).alias("bucket"))


def hashing_embedding_sparse(spark, sf):
    return embed.sparse_embedding(_english(spark, sf), ["doc_id"], dimensions=256).select("doc_id", "bucket", F.round("value", 6).alias("value"))


def candidate_entities(spark, sf):
    return extract.candidate_entities(_english(spark, sf), ["doc_id"])


def entity_classify(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"))
    more = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("Tax Board of "), "n_name").alias("name"))
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return docs.unionByName(more).unionByName(regions).distinct().select("k", "name", text.classify_entity("name").alias("type"))


def canonical_entity(spark, sf):
    runs = extract.candidate_entities(_english(spark, sf), ["doc_id"])
    return runs.select(text.canonical_key("name").alias("canon")).distinct()


#: Ways to name a window of a day and the two after it, as SQL for either engine over d (a day), y, q and m (its year, quarter
#: and month): text, start, end. {last} is the last day of a month.
SPOKEN = [
    ("concat('Q', q, ' ', y)", "make_date(y, 3 * q - 2, 1)", "{last}(make_date(y, 3 * q, 1))"),
    ("concat('between q1 to Q', q, ', ', y)", "make_date(y, 1, 1)", "{last}(make_date(y, 3 * q, 1))"),
    ("concat('H', CASE WHEN m > 6 THEN 2 ELSE 1 END, ' ', y)", "make_date(y, CASE WHEN m > 6 THEN 7 ELSE 1 END, 1)", "make_date(y, CASE WHEN m > 6 THEN 12 ELSE 6 END, CASE WHEN m > 6 THEN 31 ELSE 30 END)"),
    ("concat('in ', y)", "make_date(y, 1, 1)", "make_date(y, 12, 31)"),
    ("concat(d, ' to ', {later})", "d", "{later}"),
    ("concat('from ', d, ' → ', {later})", "d", "{later}"),
    ("CAST(d AS VARCHAR(10))", "d", "{next}"),
    ("concat('as of ', d)", "d", "d"),
    ("concat('as of ', {month}, ' ', {day}, ', ', y)", "d", "d"),
    ("concat({month}, ' ', y)", "make_date(y, m, 1)", "{last}(d)"),
    ("concat({month}, ' ', y, ' through ', {month}, ' ', y + 1)", "make_date(y, m, 1)", "{last}(make_date(y + 1, m, 1))"),
    ("'current quarter'", "make_date(y, 3 * q - 2, 1)", "{last}(make_date(y, 3 * q, 1))"),
    ("'this year'", "make_date(y, 1, 1)", "make_date(y, 12, 31)"),
    ("'today'", "d", "d"),
    ("'the last 90 days'", "{ago}", "d"),
    ("'year 3000'", "NULL", "NULL"),
    ("'what changed?'", "NULL", "NULL"),
]


def window_words(spark, sf):
    """Windows in words around each day that an order has, read on that day."""
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).where("d IS NOT NULL").distinct()
    days = days.selectExpr("d", "year(d) AS y", "quarter(d) AS q", "month(d) AS m")
    said = F.array(*[F.expr(text.format(later="date_add(d, 200)", month="date_format(d, 'MMMM')", day="day(d)")) for text, _, _ in SPOKEN])
    rows = days.select("d", F.explode(said).alias("text"))
    return rows.select("d", "text", window.window_column(F.col("text"), F.col("d")).alias("w")).select("d", "text", "w.start", "w.end")


def jaccard_pairs(spark, sf):
    """Neighbouring documents' word overlap."""
    docs = _english(spark, sf)
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(text.token_overlap("text", "other"), 6).alias("overlap"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, for the queries that SQL's patterns can't follow."""
    return table(spark, sf, "documents").select("doc_id", "text")


def word_tokens_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", F.explode(text.word_tokens("text")).alias("w")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("w").alias("distinct_tokens"))


def term_frequency_documents(spark, sf):
    return embed.term_frequencies(_documents(spark, sf), ["doc_id"])


def hash_bucket_documents(spark, sf):
    words = _documents(spark, sf).select(F.explode(text.word_tokens("text")).alias("term")).distinct()
    return words.select("term", embed.bucket(F.col("term")).alias("bucket"))


def hashing_embedding_sparse_documents(spark, sf):
    return embed.sparse_embedding(_documents(spark, sf), ["doc_id"], dimensions=256).select("doc_id", "bucket", F.round("value", 6).alias("value"))


def candidate_entities_documents(spark, sf):
    return extract.candidate_entities(_documents(spark, sf), ["doc_id"])


def canonical_entity_documents(spark, sf):
    return candidate_entities_documents(spark, sf).select(text.canonical_key("name").alias("canon")).distinct()


def jaccard_pairs_documents(spark, sf):
    """Neighbouring documents' word overlap."""
    docs = _documents(spark, sf)
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(text.token_overlap("text", "other"), 6).alias("overlap"))


def find_dates_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", F.posexplode(extract.find_dates("text")).alias("i", "d")).select("doc_id", "i", F.col("d.day").alias("day"), F.col("d.label").alias("label"))


def chunk_window_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", extract.chunk_window("text").alias("w")).select("doc_id", "w.start", "w.end")


def relation_frames_documents(spark, sf):
    return extract.relation_frames(_documents(spark, sf), ["doc_id"]).select("doc_id", "subject", "predicate", "object", "valid_from", "valid_until")


def window_grammar_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", window.window_column(F.col("text"), F.lit(AS_OF)).alias("w")).select("doc_id", "w.start", "w.end")


def vector_topk(spark, sf):
    """The ten nearest vectors of each vector whose id is divisible by 100."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest.nearest_of_each(v, q, 10)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    start = F.date_add(F.to_date(F.lit("1996-01-01")), (F.col("vec_id") % 1000).cast("int"))
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("doc"), "label").alias("doc_id"), F.concat(F.lit("doc"), "label").alias("doc_name"), F.concat(F.lit("vector "), "vec_id").alias("text"), F.col("label").cast("int").alias("page"), start.alias("start"), F.when(F.col("label") % 2 == 0, F.date_add(start, 90)).alias("end"), F.lit(None).cast("string").alias("start_label"), F.lit(None).cast("string").alias("end_label"), F.col("embedding").alias("vector"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]


def vector_topk_temporal(spark, sf):
    return retrieval.nearest(_chunks(spark, sf), _query_vector(spark, sf), 10, ("1997-01-01", "1997-02-28")).select("chunk_id", "start", "end", F.round("score", 6).alias("score"))


def broad_recall_backfill(spark, sf):
    chunks, v = _chunks(spark, sf), _query_vector(spark, sf)
    hits = retrieval.nearest(chunks, v, 6, ("1996-01-01", "1996-01-02"))
    return retrieval.with_broad_recall(hits, chunks, v, 6).select("chunk_id", "lens", F.round("score", 6).alias("score"))


def _answer_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    hits = retrieval.nearest(_chunks(spark, sf), _query_vector(spark, sf), 6, ("1997-01-01", "1997-02-28")).withColumn("lens", F.lit(0))
    edges = facts(spark, sf).where("subject = 'customer#7' AND valid_from < '1996-01-01'").withColumn("hop", F.lit(1))
    return hits, edges


def citations(spark, sf):
    out = answers.citations(*_answer_parts(spark, sf))
    return out.select("key", "kind", "doc_id", "chunk_id", "validity", "snippet")


def extractive_answer(spark, sf):
    return answers.extractive_answer(*_answer_parts(spark, sf), "1997")


def compare_narrative(spark, sf):
    f = facts(spark, sf).where("subject = 'customer#7'")
    from factlens.operators.intervals import context_diff

    return answers.narrative(context_diff(f.where("valid_from < '1996-06-01'"), f.where("valid_until > '2001-06-01' OR predicate = 'returns'")), "before", "after")


NAMES = [
    "text_clean", "token_estimate", "paragraph_split", "chunk_documents", "word_tokens", "term_frequency", "hash_bucket", "hashing_embedding_sparse", "candidate_entities", "entity_classify", "canonical_entity",
    "window_words", "jaccard_pairs", "vector_topk", "vector_topk_temporal", "broad_recall_backfill", "citations",
    "extractive_answer", "compare_narrative",
    "word_tokens_documents", "term_frequency_documents", "hash_bucket_documents", "hashing_embedding_sparse_documents", "candidate_entities_documents", "canonical_entity_documents", "jaccard_pairs_documents",
    "find_dates_documents", "chunk_window_documents", "relation_frames_documents", "window_grammar_documents",
]
QUERIES = {n: globals()[n] for n in NAMES}

EN = "(SELECT doc_id, text FROM documents WHERE lang = 'en' AND strlen(text) = length(text))"
STOP = "(" + ", ".join(f"'{w}'" for w in text.EMBEDDING_STOPWORDS) + ")"
TOK = f"tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_'']+')) AS term FROM {EN}) WHERE term NOT IN {STOP})"
BUCKET = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(8), lambda i: CAST('0x' || substr(md5(term), CAST(i * 4 + 1 AS BIGINT), 4) AS BIGINT))), lambda a, x: (a * 65536 + x) % {})"
NAMED = rf"""runs AS (
  SELECT doc_id, unnest(regexp_extract_all(s, '\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*){{0,3}}\b')) AS run
  FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM {EN})
), bare AS (SELECT doc_id, run, regexp_replace(regexp_replace(run, '\s+', ' ', 'g'), '(?i)^(?:(?:the|an?)(?:\s+|$))+', '') AS bare FROM runs),
named AS (SELECT doc_id, run AS name FROM bare WHERE bare <> '' UNION ALL SELECT doc_id, bare FROM bare WHERE bare LIKE '% %'),
ranked AS (SELECT doc_id, name, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, name) AS INTEGER) AS rank FROM named GROUP BY doc_id, name QUALIFY rank <= 24)"""
CLEAN = r"trim(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), '\s+([,.;:])', '\1', 'g'), chr(32) || chr(9) || chr(10) || chr(13))"
DISTANCE = "round(list_sum(list_transform(list_zip({}, {}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)), 6)"
CH = "ch AS (SELECT *, CASE WHEN label % 2 = 0 THEN \"start\" + 90 END AS \"end\" FROM (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label, embedding, DATE '1996-01-01' + CAST(vec_id % 1000 AS INTEGER) AS \"start\" FROM embeddings)), sc AS (SELECT ch.*, " + DISTANCE.format("ch.embedding", "q.embedding") + " AS score FROM ch, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"
WORDS3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2))"


ORACLES = {
    "text_clean": f"SELECT doc_id, md5({CLEAN}) AS clean_md5, CAST(length({CLEAN}) AS INTEGER) AS n FROM documents",
    "token_estimate": "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents",
    "paragraph_split": rf"SELECT doc_id, position, md5(text) AS text_md5, position = 0 AND NOT regexp_matches(raw, '[-–]\s*$') AS fresh FROM (SELECT doc_id, raw, {CLEAN.replace('(text,', '(raw,')} AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(raw, chr(32) || chr(9) || chr(13)) <> '')",
    "word_tokens": f"WITH {TOK} SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS distinct_tokens FROM tok GROUP BY doc_id",
    "term_frequency": f"WITH {TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term HAVING count(*) >= 3",
    "hash_bucket": f"WITH {TOK} SELECT term, CAST({BUCKET.format(768)} AS INTEGER) AS bucket FROM (SELECT DISTINCT term FROM tok)",
    "hashing_embedding_sparse": f"WITH {TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), w AS (SELECT term, CAST({BUCKET.format(256)} AS INTEGER) AS bucket FROM (SELECT DISTINCT term FROM tok)), v AS (SELECT doc_id, bucket, sum(1 + ln(tf)) AS value FROM tf JOIN w USING (term) GROUP BY doc_id, bucket) SELECT doc_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM v",
    "candidate_entities": f"WITH {NAMED} SELECT * FROM ranked",
    "canonical_entity": f"WITH {NAMED} SELECT DISTINCT lower(regexp_replace(trim(name), '^([Tt][Hh][Ee]|[Aa][Nn]?)\\s+', '')) AS canon FROM ranked",
    "entity_classify": "SELECT k, name, CASE WHEN regexp_matches(lower(name), 'regulation|act|directive|standard|policy|protocol|guideline|circular') THEN 'Regulation' WHEN regexp_matches(lower(name), 'firm|bank|authority|company|corp|ltd|inc|commission|agency|board') THEN 'Organization' WHEN regexp_matches(lower(name), 'tax|charge|rate|fee|levy|credit|deduction|threshold') THEN 'Instrument' WHEN regexp_matches(lower(name), 'party|citizen|resident|taxpayer|entity|customer|person') THEN 'Party' WHEN regexp_matches(lower(name), 'eu|us|uk|usa|germany|france|japan|china|canada|india') THEN 'Jurisdiction' ELSE 'Concept' END AS type FROM (SELECT c_custkey AS k, c_mktsegment AS name FROM customer UNION SELECT n_nationkey, 'Tax Board of ' || n_name FROM nation UNION SELECT n_nationkey, n_name FROM nation)",
    "window_words": "WITH days AS (SELECT d, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, CAST(month(d) AS INTEGER) AS m FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)) " + " UNION ALL ".join(f'SELECT d, {a} AS text, CAST({b} AS DATE) AS "start", CAST({c} AS DATE) AS "end" FROM days' for a, b, c in SPOKEN).format(last="last_day", later="CAST(d + 200 AS DATE)", next="d + 1", month="strftime(d, '%B')", day="day(d)", ago="d - 90"),
    "jaccard_pairs": f"WITH t AS (SELECT doc_id, {WORDS3.format('text')} AS w FROM {EN}) SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS overlap FROM t a JOIN t b ON b.doc_id = a.doc_id + 1",
    "vector_topk": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, " + DISTANCE.format("v.embedding", "q.embedding") + " AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) QUALIFY rank <= 10",
    "vector_topk_temporal": f"WITH {CH} SELECT chunk_id, \"start\", \"end\", score FROM sc WHERE (\"end\" IS NULL OR \"end\" >= DATE '1997-01-01') AND \"start\" <= DATE '1997-02-28' ORDER BY score, chunk_id LIMIT 10",
    "broad_recall_backfill": f"WITH {CH}, hits AS (SELECT chunk_id, 0 AS lens, score FROM sc WHERE (\"end\" IS NULL OR \"end\" >= DATE '1996-01-01') AND \"start\" <= DATE '1996-01-02' ORDER BY score, chunk_id LIMIT 6), broad AS (SELECT chunk_id, 1 AS lens, score FROM sc ORDER BY score, chunk_id LIMIT 10) SELECT * FROM hits UNION ALL SELECT * FROM broad WHERE (SELECT count(*) FROM hits) < 6 AND chunk_id NOT IN (SELECT chunk_id FROM hits)",
    "citations": f"WITH {FACTS}, {CH} SELECT 'v' || (row_number() OVER (ORDER BY score, chunk_id) - 1) AS key, 'chunk' AS kind, 'doc' || label AS doc_id, chunk_id, CAST(\"start\" AS VARCHAR) || ' → ' || coalesce(CAST(\"end\" AS VARCHAR), '…') AS validity, 'vector ' || chunk_id AS snippet FROM (SELECT * FROM sc WHERE (\"end\" IS NULL OR \"end\" >= DATE '1997-01-01') AND \"start\" <= DATE '1997-02-28' ORDER BY score, chunk_id LIMIT 6) UNION ALL SELECT 'g' || (row_number() OVER (ORDER BY edge_seq) - 1), 'graph_fact', doc_id, chunk_id, CAST(valid_from AS VARCHAR) || ' → ' || coalesce(CAST(valid_until AS VARCHAR), '…'), subject || ' → ' || predicate || ' → ' || object FROM facts WHERE subject = 'customer#7' AND valid_from < DATE '1996-01-01'",
    "extractive_answer": f"WITH {FACTS}, {CH}, l AS (SELECT 1 AS part, row_number() OVER (ORDER BY score, chunk_id) - 1 AS i, label, \"start\", \"end\", chunk_id, NULL AS f FROM (SELECT * FROM sc WHERE (\"end\" IS NULL OR \"end\" >= DATE '1997-01-01') AND \"start\" <= DATE '1997-02-28' ORDER BY score, chunk_id LIMIT 5) UNION ALL SELECT 2, row_number() OVER (ORDER BY edge_seq) - 1, NULL, valid_from, valid_until, NULL, subject || ' --[' || predicate || ']--> ' || object FROM facts WHERE subject = 'customer#7' AND valid_from < DATE '1996-01-01') SELECT 'Evidence for “1997” (extractive engine):' || chr(10) || string_agg(CASE part WHEN 1 THEN '[v' || i || '] (doc' || label || ', p' || label || ', valid ' || CAST(\"start\" AS VARCHAR) || ' → ' || coalesce(CAST(\"end\" AS VARCHAR), '…') || ') vector ' || chunk_id || '…' ELSE '[g' || i || '] ' || f || ' (valid ' || CAST(\"start\" AS VARCHAR) || ' → ' || coalesce(CAST(\"end\" AS VARCHAR), '…') || ')' END, chr(10) ORDER BY part, i) AS answer FROM l WHERE part = 1 OR i < 20",
}
