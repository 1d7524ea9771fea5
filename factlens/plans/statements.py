"""Queries of extraction and of windows in words over sentences that are made from the tables' rows, with their oracle SQL: what is
read from a sentence has to be what the row says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions import extract, window
from factlens.functions.extract import VERBS
from factlens.operators import retrieval, similarity
from factlens.plans.facts import table
from factlens.plans.texts import SPOKEN


def _slash(day: str) -> Column:
    return F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order, line, part and supplier (of repeated ones the latest): doc, lot, subject, predicate, object, valid_from,
    valid_until, and the sentence that says so."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("od"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # Dealt by order once, for the latest lines and for the join.
    li = table(spark, sf, "lineitem").repartition("l_orderkey").groupBy(*keys).agg(F.max(F.struct(F.col("l_shipdate").cast("date").alias("sd"), "l_linestatus")).alias("x")).select(*keys, "x.*")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("od IS NOT NULL AND sd IS NOT NULL")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(VERBS) + 1).cast("int"))
    rows = rows.select(
        F.col("l_orderkey").alias("doc"),
        F.concat_ws("-", "l_linenumber", "l_suppkey", "l_partkey").alias("lot"),
        F.concat(F.lit("Customer-"), "o_custkey").alias("subject"),
        verb.alias("predicate"),
        F.concat(F.lit("Part-"), "l_partkey", F.lit(" Lot-"), "l_linenumber", F.lit("-"), "l_suppkey").alias("object"),
        F.least("od", "sd").alias("valid_from"),
        F.when(F.col("l_linestatus") != "O", F.greatest("od", "sd")).alias("valid_until"),
        (F.col("l_linenumber") % 2 == 0).alias("slashed"),
    )
    say = lambda c: F.when(F.col("slashed"), _slash(c)).otherwise(F.col(c).cast("string"))
    end = F.when(F.col("valid_until").isNotNull(), F.concat(F.lit(" until "), say("valid_until"))).otherwise(F.lit(""))
    return rows.withColumn("sentence", F.concat(F.lit("The "), "subject", F.lit(" "), "predicate", F.lit(" the "), "object", F.lit(" effective "), say("valid_from"), end, F.lit("."))).drop("slashed")


def relation_frames(spark, sf):
    """An order's lines as one text, and the relations read from it."""
    docs = lines(spark, sf).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lot", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return extract.relation_frames(docs, ["doc"]).select("doc", "subject", "predicate", "object", "valid_from", "valid_until")


def chunk_window(spark, sf):
    return lines(spark, sf).select("doc", "lot", extract.chunk_window("sentence").alias("w")).select("doc", "lot", "w.start", "w.end")


def find_dates(spark, sf):
    """Each order's day and later ones, as dates, a month, a quarter and a year in one text."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).where("d IS NOT NULL")
    days = o.select("o_orderkey", "d", *[F.date_add("d", n).alias(f"d{n}") for n in (30, 60, 90, 400)])
    text = F.concat(F.lit("On "), F.col("d").cast("string"), F.lit(", paid "), _slash("d30"), F.lit("; "), F.date_format("d60", "MMMM yyyy"), F.lit(" and Q"), F.quarter("d90"), F.lit(" "), F.year("d90"), F.lit(", not before "), F.year("d400"), F.lit("."))
    return days.select("o_orderkey", F.posexplode(extract.find_dates(text)).alias("i", "x")).select("o_orderkey", "i", F.col("x.day").alias("day"), F.col("x.label").alias("label"))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).where("d IS NOT NULL")
    return days.selectExpr("o_orderkey", "d", "year(d) AS y", "quarter(d) AS q", "month(d) AS m")


def window_grammar(spark, sf):
    """A way to name a window for each order, read on the order's day."""
    said = F.array(*[F.expr(text.format(later="date_add(d, 200)", month="date_format(d, 'MMMM')", day="day(d)")) for text, _, _ in SPOKEN])
    rows = _spoken(spark, sf).select("o_orderkey", "d", F.element_at(said, (F.col("o_orderkey") % len(SPOKEN) + 1).cast("int")).alias("text"))
    return rows.select("o_orderkey", "text", window.window_column(F.col("text"), F.col("d")).alias("w")).select("o_orderkey", "text", "w.start", "w.end")


def window_quarters(spark, sf):
    rows = _spoken(spark, sf).select(F.concat(F.lit("in Q"), "q", F.lit(" "), "y").alias("text")).distinct()
    return rows.select("text", window.quarter_window(F.col("text")).alias("w")).select("text", "w.start", "w.end")


def window_halves(spark, sf):
    rows = _spoken(spark, sf).select(F.concat(F.lit("H"), F.when(F.col("m") > 6, 2).otherwise(1), F.lit(", "), "y").alias("text")).distinct()
    return rows.select("text", window.half_window(F.col("text")).alias("w")).select("text", "w.start", "w.end")


def window_months(spark, sf):
    rows = _spoken(spark, sf).select(F.date_format("d", "MMMM yyyy").alias("text")).distinct()
    return rows.select("text", window.month_window(F.col("text")).alias("w")).select("text", "w.start", "w.end")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))


def seed_dedupe(spark, sf):
    """Of each order's parts, by name, those whose words are not too like those of one before."""
    names = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return names.select("l_orderkey", F.posexplode(retrieval.distinct_seeds(F.col("names"))).alias("i", "name"))


def question_node_match(spark, sf):
    """Parts that a question about the next part names as well."""
    parts = _parts(spark, sf)
    asked = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("What does the "), "name", F.lit(" cost, and is it small or red?")).alias("question"))
    return parts.join(asked, "p_partkey").where(retrieval.question_names_node(F.col("name"), F.col("question"))).select("p_partkey", "name")


def similar_parts(spark, sf):
    """Pairs of different word sets of parts' names that are alike."""
    return similarity.similar_sets(similarity.token_sets(_parts(spark, sf))).select("a_key", "b_key", F.round("likeness", 6).alias("likeness"))


def similar_names(spark, sf):
    """The same for the names found in all documents."""
    names = extract.candidate_entities(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]).select("name").distinct()
    return similarity.similar_sets(similarity.token_sets(names)).select("a_key", "b_key", F.round("likeness", 6).alias("likeness"))


#: What stands around a reply's JSON, by kind: fenced, with words around it, plain; the fourth kind is broken off.
FRAMES = [("```json\n", "\n```"), ("Here it is: ", " Bye."), ("", ""), ("no json {", "")]


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Each line as a model's reply: doc, lot, reply."""
    rows = lines(spark, sf)
    end = F.coalesce(F.col("valid_until").cast("string"), F.lit("none"))
    body = F.to_json(F.struct(
        F.array(F.struct(F.col("subject").alias("name"), F.lit("Party").alias("type")), F.struct(F.lit(" ").alias("name"), F.lit("Party").alias("type"))).alias("entities"),
        F.array(
            F.struct(F.concat(F.lit(" "), "subject").alias("subject"), "predicate", "object", F.struct(F.concat(F.col("valid_from").cast("string"), F.lit(" 10:00:00")).alias("start"), end.alias("end")).alias("validity"), "sentence"),
            F.struct("subject", F.lit("").alias("predicate"), "object", F.struct(F.lit("2024-02-30").alias("start"), F.lit("").alias("end")).alias("validity"), "sentence"),
        ).alias("relations"),
    ))
    kind = F.substring_index("lot", "-", 1).cast("int") % 4
    around = [F.element_at(F.array(*[F.lit(f[i]) for f in FRAMES]), kind + 1) for i in (0, 1)]
    return rows.select("doc", "lot", F.concat(around[0], F.when(kind == 3, F.substring(body, 1, 40)).otherwise(body), around[1]).alias("reply"))


def llm_json_salvage(spark, sf):
    found = extract.reply_relations(replies(spark, sf), ["doc", "lot"])
    return found.select("doc", "lot", "subject", "predicate", "object", "valid_from", "valid_until", "start_label")


def llm_reply_entities(spark, sf):
    return extract.reply_entities(replies(spark, sf), ["doc", "lot"]).select("doc", "lot", "name", "type")


NAMES = ["relation_frames", "chunk_window", "find_dates", "window_grammar", "window_quarters", "window_halves", "window_months", "seed_dedupe", "question_node_match", "llm_json_salvage", "llm_reply_entities", "similar_parts", "similar_names"]
QUERIES = {n: globals()[n] for n in NAMES}

_VERBS = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"
LINES = f"""x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max((CAST(l_shipdate AS DATE), l_linestatus)) AS x FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL
), lines AS (
  SELECT l_orderkey AS doc, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS lot, 'Customer-' || o_custkey AS subject, {_VERBS}[CAST((l_partkey + l_linenumber) % {len(VERBS)} + 1 AS INTEGER)] AS predicate,
    'Part-' || l_partkey || ' Lot-' || l_linenumber || '-' || l_suppkey AS object, least(CAST(o_orderdate AS DATE), x[1]) AS valid_from, CASE WHEN x[2] <> 'O' THEN greatest(CAST(o_orderdate AS DATE), x[1]) END AS valid_until, l_linenumber % 4 AS kind
  FROM x JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL
)"""
DAYS = "days AS (SELECT o_orderkey, d, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, CAST(month(d) AS INTEGER) AS m FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL))"
PARTS = "parts AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part)"
WORDS3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2))"
_SHARED = f"len(list_intersect({WORDS3.format('x[1]')}, {WORDS3.format('h')}))"
_LIKE = f"{_SHARED} / (len({WORDS3.format('x[1]')}) + len({WORDS3.format('h')}) - {_SHARED}) > 0.4"
ORACLES = {
    "relation_frames": f"WITH {LINES} SELECT doc, subject, predicate, object, valid_from, valid_until FROM lines",
    "chunk_window": f'WITH {LINES} SELECT doc, lot, valid_from AS "start", valid_until AS "end" FROM lines',
    "find_dates": f"""WITH {DAYS}, e AS (
  SELECT o_orderkey, year(d + 60) AS y1, year(d + 90) AS y2, year(d + 400) AS y3, [
    {{'k': 0, 'day': d, 'label': CAST(d AS VARCHAR)}}, {{'k': 1, 'day': d + 30, 'label': month(d + 30) || '/' || day(d + 30) || '/' || year(d + 30)}},
    {{'k': 2, 'day': CAST(date_trunc('month', d + 60) AS DATE), 'label': lower(strftime(d + 60, '%B %Y'))}},
    {{'k': 3, 'day': CAST(date_trunc('quarter', d + 90) AS DATE), 'label': 'q' || quarter(d + 90) || ' ' || year(d + 90)}},
    {{'k': 4, 'day': CAST(date_trunc('quarter', d + 90) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY, 'label': 'q' || quarter(d + 90) || ' ' || year(d + 90)}}] AS own FROM days
), ys AS (SELECT *, list_concat([y1], CASE WHEN y2 <> y1 THEN [y2] ELSE [] END, CASE WHEN y3 NOT IN (y1, y2) THEN [y3] ELSE [] END) AS years FROM e),
r AS (
  SELECT o_orderkey, unnest(own, recursive := true) FROM ys
  UNION ALL SELECT o_orderkey, k, day, label FROM (SELECT o_orderkey, own, unnest(years) AS yy, 4 + generate_subscripts(years, 1) AS k, make_date(yy, 1, 1) AS day, CAST(yy AS VARCHAR) AS label FROM ys) WHERE NOT list_contains(list_transform(own, lambda o: CAST(o.day AS DATE)), day)
) SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY day, k) - 1 AS INTEGER) AS i, CAST(day AS DATE) AS day, label FROM r""",
    "window_grammar": f"WITH {DAYS} " + " UNION ALL ".join(f'SELECT o_orderkey, {a} AS text, CAST({b} AS DATE) AS "start", CAST({c} AS DATE) AS "end" FROM days WHERE o_orderkey % {len(SPOKEN)} = {i}' for i, (a, b, c) in enumerate(SPOKEN)).format(last="last_day", later="CAST(d + 200 AS DATE)", next="d + 1", month="strftime(d, '%B')", day="day(d)", ago="d - 90"),
    "window_quarters": f"WITH {DAYS} SELECT DISTINCT 'in Q' || q || ' ' || y AS text, make_date(y, 3 * q - 2, 1) AS \"start\", last_day(make_date(y, 3 * q, 1)) AS \"end\" FROM days",
    "window_halves": f"WITH {DAYS}, h AS (SELECT DISTINCT y, CASE WHEN m > 6 THEN 2 ELSE 1 END AS h FROM days) SELECT 'H' || h || ', ' || y AS text, make_date(y, 6 * h - 5, 1) AS \"start\", last_day(make_date(y, 6 * h, 1)) AS \"end\" FROM h",
    "window_months": f"WITH {DAYS} SELECT DISTINCT strftime(d, '%B %Y') AS text, make_date(y, m, 1) AS \"start\", last_day(d) AS \"end\" FROM days",
    "seed_dedupe": f"""WITH {PARTS}, n AS (SELECT l_orderkey, list_sort(list_distinct(list(name))) AS names FROM lineitem JOIN parts ON l_partkey = p_partkey GROUP BY l_orderkey),
  kept AS (SELECT l_orderkey, list_reduce(list_transform(names, lambda n: [n]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: {_LIKE})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM n)
SELECT l_orderkey, CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS i, unnest(kept) AS name FROM kept""",
    "question_node_match": f"""WITH {PARTS}, w AS (SELECT a.p_partkey, a.name, {WORDS3.format('a.name')} AS mine, {WORDS3.format("'What does the ' || b.name || ' cost, and is it small or red?'")} AS theirs FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, name FROM w WHERE len(mine) >= 2 AND len(list_intersect(mine, theirs)) >= greatest(2, len(mine) - 1)""",
    "similar_parts": f"""WITH {PARTS}, s AS (SELECT DISTINCT list_sort({WORDS3.format("regexp_replace(trim(name), '^([Tt][Hh][Ee]|[Aa][Nn]?)\\s+', '')")}) AS w FROM parts),
  t AS (SELECT array_to_string(w, ' ') AS key, len(w) AS l, unnest(w) AS token FROM s), o AS (SELECT a.key AS a_key, b.key AS b_key, any_value(a.l) AS la, any_value(b.l) AS lb, count(*) AS o FROM t a JOIN t b USING (token) WHERE a.key < b.key GROUP BY ALL)
SELECT a_key, b_key, round(o / (la + lb - o), 6) AS likeness FROM o WHERE o / (la + lb - o) > 0.4""",
    "llm_json_salvage": f"WITH {LINES} SELECT doc, lot, subject, predicate, object, valid_from, valid_until, CAST(valid_from AS VARCHAR) AS start_label FROM lines WHERE kind <> 3",
    "llm_reply_entities": f"WITH {LINES} SELECT doc, lot, subject AS name, 'Party' AS type FROM lines WHERE kind <> 3",
}
