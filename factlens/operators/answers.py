"""Answers from a context: citations, the extractive answer, the narrative of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.extract import reply_json
from factlens.functions.interval import rendered, rendered_validity
from factlens.operators.extraction import Load, replies
from factlens.operators.intervals import context_diff
from factlens.operators.retrieval import Context

MOST_HITS, MOST_FACTS, MOST_DEFAULT = 5, 20, 30


def _ordinal(df: DataFrame, *order) -> DataFrame:
    # Both inputs hold a bounded answer's rows.
    return df.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)


def _snippet(text: str, n: int) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, n)


def _span(df: DataFrame) -> Column:
    return rendered_validity("start", "end", "start_label", "end_label") if "start_label" in df.columns else rendered("start", "end")


def citations(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per hit (v0, v1, ...) and fact (g0, g1, ...): key, kind, doc_id, chunk_id, page, score, validity, snippet."""
    h = _ordinal(hits, "lens", "score", "chunk_id")
    e = _ordinal(edges, "hop", "edge_seq")
    v = h.select(F.concat(F.lit("v"), "i").alias("key"), F.lit("chunk").alias("kind"), "doc_id", "chunk_id", F.col("page").cast("int").alias("page"), F.round("score", 4).alias("score"), rendered("start", "end").alias("validity"), _snippet("text", 280).alias("snippet"))
    fact = F.concat_ws(" → ", "subject", "predicate", "object")
    g = e.select(F.concat(F.lit("g"), "i").alias("key"), F.lit("graph_fact").alias("kind"), "doc_id", "chunk_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("score"), rendered_validity("valid_from", "valid_until", "start_label", "end_label").alias("validity"), fact.alias("snippet"))
    return v.unionByName(g)


def facts(edges: DataFrame, most: int = MOST_DEFAULT) -> DataFrame:
    out = edges.orderBy("hop", "edge_seq").limit(most)
    return out.select("subject", "predicate", "object", rendered_validity("valid_from", "valid_until", "start_label", "end_label").alias("validity"), "evidence", "doc_id", "chunk_id")


def extractive_answer(hits: DataFrame, edges: DataFrame, label: str = "") -> DataFrame:
    """One row: the answer text, from up to five hits and twenty facts."""
    h = _ordinal(hits, "lens", "score", "chunk_id").where(F.col("i") < MOST_HITS)
    e = _ordinal(edges, "hop", "edge_seq").where(F.col("i") < MOST_FACTS)
    hit = h.select(F.lit(1).alias("part"), "i", F.format_string("[v%d] (%s, p%d, valid %s) %s…", "i", "doc_name", F.col("page").cast("int"), rendered("start", "end"), _snippet("text", 220)).alias("line"))
    fact = e.select(F.lit(2).alias("part"), "i", F.format_string("[g%d] %s --[%s]--> %s (valid %s)", "i", "subject", "predicate", "object", rendered_validity("valid_from", "valid_until", "start_label", "end_label")).alias("line"))
    lines = hit.unionByName(fact).agg(F.sort_array(F.collect_list(F.struct("part", "i", "line"))).alias("a"))
    head = F.lit(f"Evidence for “{label or 'open window'}” (extractive engine):")
    body = F.when(F.size("a") == 0, F.array(F.lit("Insufficient evidence within the requested window."))).otherwise(F.transform("a", lambda x: x["line"]))
    return lines.select(F.array_join(F.concat(F.array(head), body), "\n").alias("answer"))


def question_prompt(context: Context, evidence: Column) -> Column:
    """What a model is asked about a question, with the evidence in words."""
    asked = 'Answer from the evidence alone, for the window asked about, and cite it like [v0] or [g1]. Reply with JSON: {"answer": "..."}.'
    return F.concat(F.lit(f"{asked}\nQuestion: {context.question}\nWindow: {context.window.label or 'open'}\n"), evidence)


def answer(context: Context, load: Load | None = None) -> DataFrame:
    """One row (question, answer, engine): by a given model (load, see operators.extraction), or extractive where there is none, it
    fails, or its reply holds no answer."""
    out = extractive_answer(context.hits, context.edges, context.window.label).select(F.lit(context.question).alias("question"), "answer")
    if load is None:
        return out.withColumn("engine", F.lit("extractive"))
    said = replies(out, question_prompt(context, F.col("answer")), load)
    own = F.nullif(F.trim(F.get_json_object(reply_json("reply"), "$.answer")), F.lit(""))
    return said.select("question", F.coalesce(own, "answer").alias("answer"), F.when(own.isNotNull(), "model").otherwise("extractive").alias("engine"))


def narrative(diff: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """One row: the text of a comparison (context_diff)."""
    count = lambda b: F.count_if(F.col("bucket") == b).cast("string")
    fact = F.concat("subject", F.lit(" --["), "predicate", F.lit("]--> "), "object")
    valid = lambda side: rendered(F.col(f"{side}.valid_from"), F.col(f"{side}.valid_until"))
    line = F.when(F.col("bucket") == "removed", F.struct(F.lit(0).alias("k"), F.concat(F.lit("  ✗ "), fact, F.lit(" (was valid "), valid("before"), F.lit(")")).alias("line"))).when(F.col("bucket") == "changed", F.struct(F.lit(1).alias("k"), F.concat(F.lit("  ↻ "), fact).alias("line"))).when(F.col("bucket") == "added", F.struct(F.lit(2).alias("k"), F.concat(F.lit("  ✓ "), fact, F.lit(" (valid "), valid("after"), F.lit(")")).alias("line")))
    agg = diff.agg(count("added").alias("a"), count("removed").alias("r"), count("changed").alias("c"), F.sort_array(F.collect_list(line)).alias("lines"))
    head = F.array(F.lit(f"Comparing “{label_a}” vs “{label_b}”:"), F.concat(F.lit("- Added: "), "a", F.lit(" fact(s)")), F.concat(F.lit("- Removed: "), "r", F.lit(" fact(s)")), F.concat(F.lit("- Changed validity/evidence: "), "c", F.lit(" fact(s)")))
    return agg.select(F.array_join(F.concat(head, F.transform("lines", lambda x: x["line"])), "\n").alias("narrative"))


def compare(a: Context, b: Context) -> tuple[DataFrame, DataFrame]:
    """(difference of the two contexts' facts, its narrative)."""
    diff = context_diff(a.edges, b.edges)
    return diff, narrative(diff, a.window.label, b.window.label)
