"""Deterministic extraction of dates, entities and dated relations from texts, as column expressions and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.text import canonical_name, classify_entity, sentences
from factlens.functions.window import MONTHS

# Words that are no object, and do not open a name by themselves.
STOPWORDS = ["the", "a", "an", "of", "and", "or", "to", "for", "in", "on", "at", "with", "by", "from", "this", "that", "these", "those", "as", "is", "are", "was", "were", "be", "been", "shall", "will", "must", "may", "should", "not", "no", "per", "its", "it", "all", "any", "each", "such", "which", "who", "whom", "whose", "within", "under"]
# Verbs of relations, and verbs that only place one in time.
VERBS = ["requires", "prohibits", "governs", "amends", "replaces", "supersedes", "imposes", "applies", "mandates", "allows", "permits", "defines", "establishes", "sets", "prescribes", "obliges", "limits", "restricts", "bars", "forbids", "authorizes"]
TIMING_VERBS = ["effective", "take", "took", "becomes", "became", "ends", "expires", "commences"]
# What opens and what closes a time.
START_FRAME = r"starting|starts|beginning|begins|from|effective|commencing|commences|as of"
END_FRAME = r"until|through|till|expires?|expiring|ending|ends|repealed|sunset|before"

#: Verbs in the order they are tried: relations before times, longer before shorter, then by name.
VERB_ORDER = [*sorted(VERBS, key=lambda v: (-len(v), v)), *sorted(TIMING_VERBS, key=lambda v: (-len(v), v))]
MOST_ENTITIES = 24
FOUND = "array<struct<day:date,kind:int,label:string>>"
_ISO, _SLASH, _BARE = r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b(?:19|20)\d{2}\b"
# A capitalised word and what hyphens join to it is a name, whose numbers are no years; but not after a part of a year.
_NAMED = rf"(?=[A-Z])(?<![\w-])(?!(?i:{'|'.join(sorted(MONTHS, key=len, reverse=True))}|q[1-4]|h[12]|fy|cy|mid|early|late|pre|post)-)[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def date_literal(token) -> Column:
    """A year-month-day or month/day/year token as a date; null if it is none."""
    token = token if isinstance(token, Column) else F.col(token)
    return F.when(token.rlike(r"^\d{4}-"), F.try_to_date(token, "yyyy-M-d")).otherwise(F.try_to_date(token, "M/d/yyyy"))


def _dated(tokens: Column, day, kind: int) -> Column:
    return F.filter(F.transform(tokens, lambda t: F.struct(day(t).alias("day"), F.lit(kind).alias("kind"), t.alias("label"))), lambda x: x["day"].isNotNull())


def find_dates(text) -> Column:
    """The dates that a text names with their labels, by date: array of struct(day, kind, label).

    Whole dates first, then months (their first day), quarters (their first and last day), then years that stand in no
    whole date and in no name of joined parts (Part-1907, Lot-3-1950) and equal no date found before.
    """
    every = lambda of, rx: F.regexp_extract_all(of, F.lit(rx), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    year = lambda t: F.regexp_extract(t, r"(\d{4})$", 1).cast("int")
    month = lambda t: F.make_date(F.nullif(year(t), F.lit(0)), F.element_at(names, F.regexp_extract(t, r"^[a-z]+", 0)), F.lit(1))
    initials = "".join(sorted({m[0] for m in MONTHS}))
    months = lambda low: _dated(every(low, rf"\b(?=[{initials}])(?:{'|'.join(sorted(MONTHS, key=len, reverse=True))})\s+\d{{4}}\b"), month, 2)
    of_quarter = lambda t, m: F.make_date(F.nullif(year(t), F.lit(0)), 3 * F.substring(t, 2, 1).cast("int") - m, F.lit(1))
    both_ends = lambda q: F.concat(_dated(q, lambda t: of_quarter(t, 2), 3), _dated(q, lambda t: F.last_day(of_quarter(t, 0)), 3))
    quarters = lambda low: _let(every(low, r"\bq[1-4]\s*,?\s*\d{4}\b"), both_ends)
    # Whole dates are blanked out before years are looked for, so none is found inside one; names only where there are any.
    blank = lambda t, days: F.aggregate(days, t, lambda s, x: F.replace(s, x["label"], F.lit(" ")))
    bare = lambda t: F.array_distinct(every(F.regexp_replace(t, _NAMED, " "), _BARE))
    years = lambda t, before: F.filter(_dated(bare(t), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1)), 4), lambda y: ~F.exists(before, lambda b: b["day"] == y["day"]))
    with_years = lambda whole, t: F.when(t.rlike(_BARE), F.concat(whole, years(t, whole))).otherwise(whole)
    by_day = lambda a: F.sort_array(F.transform(a, lambda x, i: F.struct(x["day"].alias("day"), i.alias("i"), x["kind"].alias("kind"), x["label"].alias("label"))))

    def of(t: Column) -> Column:
        days = F.concat(_dated(every(t, _ISO), date_literal, 0), _dated(every(t, _SLASH), date_literal, 1))
        return _let(days, lambda d: _let(F.concat(d, _let(F.lower(t), lambda low: F.concat(months(low), quarters(low)))), lambda whole: _let(blank(t, d), lambda rest: with_years(whole, rest))))

    found = _let(text if isinstance(text, Column) else F.col(text), of)
    return F.transform(by_day(found), lambda x: F.struct(x["day"].alias("day"), x["kind"].alias("kind"), x["label"].alias("label"))).cast(FOUND)


def chunk_window(text) -> Column:
    """struct(start, end, start_label, end_label) from a text's first to its last date; without end if the last one's
    nearest frame in the 40 characters before it opens a time and no closing frame follows it."""
    text = text if isinstance(text, Column) else F.col(text)
    low = F.lower(text)

    def of(found: Column) -> Column:
        first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
        label = F.lower(last["label"])
        at = F.length(low) - F.length(label) + 2 - F.instr(F.reverse(low), F.reverse(label))
        before = F.substr(low, F.greatest(F.lit(1), at - 40), F.least(F.lit(40), at - 1))
        after = F.substr(low, at + F.length(label))
        nearest = F.regexp_extract(before, rf"(?s).*\b({START_FRAME}|{END_FRAME})\b", 1)
        opens = nearest.rlike(rf"^(?:{START_FRAME})$") & ~after.rlike(rf"\b(?:{END_FRAME})\b")
        end = lambda x: F.when(opens, None).otherwise(x)
        return F.struct(first["day"].alias("start"), end(last["day"]).alias("end"), first["label"].alias("start_label"), end(last["label"]).alias("end_label"))

    return F.element_at(F.transform(F.array(find_dates(text)), of), 1)


def _runs(sentence: Column) -> Column:
    """The runs of one to four capitalised words of a sentence."""
    return F.regexp_extract_all(sentence, F.lit(r"\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*){0,3}\b"), F.lit(0))


def _bare(run: Column) -> Column:
    """A run without articles before it."""
    return F.regexp_replace(F.regexp_replace(run, r"\s+", " "), r"(?i)^(?:(?:the|a|an)(?:\s+|$))+", "")


def _names(said: Column, most: int) -> Column:
    """What candidate_entities finds in an array of sentences (struct with field s), from the last rank to the first:
    array of struct(name, low)."""
    named = lambda run: _let(_bare(run), lambda b: F.when(b == "", F.array().cast("array<string>")).when(b.contains(" "), F.array(run, b)).otherwise(F.array(run)))
    every = F.flatten(F.transform(F.flatten(F.transform(said, lambda x: _runs(x["s"]))), named))

    def ranked(names: Column) -> Column:
        # The names are sorted, so a name's count is the way to where the next one begins.
        first = F.filter(F.transform(names, lambda x, i: F.when(F.coalesce(F.get(names, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        counted = lambda a: F.transform(a, lambda i, k: F.struct((i - F.coalesce(F.get(a, k + 1), F.size(names))).alias("n"), F.get(names, i).alias("name")))
        return F.slice(F.sort_array(_let(first, counted)), 1, most)

    return F.reverse(F.transform(_let(F.sort_array(every), ranked), lambda x: F.struct(x["name"].alias("name"), F.lower(x["name"]).alias("low"))))


def candidate_entities(chunks: DataFrame, ids: list[str], text: str = "text", most: int = MOST_ENTITIES) -> DataFrame:
    """ids, name, n, rank: the most frequent runs of one to four capitalised words of each text.

    A run counts as it stands, and once more, without articles before it, if two words or more are left then.
    """
    runs = chunks.select(*ids, F.explode(sentences(text)).alias("s")).select(*ids, F.explode(_runs(F.col("s"))).alias("run"))
    names = runs.withColumn("bare", _bare(F.col("run"))).where("bare != ''")
    counted = names.select(*ids, F.explode(F.when(F.col("bare").contains(" "), F.array("run", "bare")).otherwise(F.array("run"))).alias("name")).groupBy(*ids, "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*ids).orderBy(F.desc("n"), "name")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def typed_entities(chunks: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """candidate_entities with canonical names and types."""
    return candidate_entities(chunks, ids, text).join(chunks.select(*ids, text), ids).select(*ids, "name", canonical_name("name").alias("canonical"), classify_entity("name", F.col(text)).alias("type"), "n", "rank")


def relation_frames(chunks: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Dated relations of each text: ids, position, subject, predicate, object, valid_from, valid_until, start_label,
    end_label, sentence, confidence.

    In each sentence the first verb with a usable object decides; of equal relations of a text the first stands, and a
    sentence whose verb repeats one goes on to its next verb.
    """
    # Names are looked for only in texts with a verb between spaces, which every frame has.
    chunks = chunks.where(F.lower(text).rlike(rf"(?U)(?:^|\s)(?:{'|'.join(VERB_ORDER)})(?:\s|$)"))
    # The rest is done inside a row, bounded by one text (and others with the same ids, which count as one text with it).
    placed = lambda t: F.transform(sentences(t), lambda s, i: F.struct(i.alias("position"), s.alias("s"), F.lower(s).alias("low")))
    rows = chunks.groupBy(*ids).agg(F.collect_list(text).alias("_texts")).select(*ids, F.sort_array(F.flatten(F.transform("_texts", placed))).alias("_said"))
    rows = rows.withColumn("_names", _names(F.col("_said"), MOST_ENTITIES))
    kind = "struct<subject:string,predicate:string,object:string>"

    def frame(low: Column, s: Column, verb: Column, at: Column) -> Column:
        name = lambda got, c: F.when(got.isNotNull(), got).when(F.contains(low, c["low"]), F.when(F.instr(low, c["low"]) < at, c["name"]))
        subject = F.coalesce(canonical_name(F.aggregate("_names", F.lit(None).cast("string"), name)), F.lit(""))
        # What follows the first time or the first stop after the verb is cut off.
        tail = F.regexp_replace(F.substr(s, at + F.length(verb)), r"(?s)(?:\b(?i:as of|until|effective|on|commencing)\b|[.!?;]|\(see).*", "")
        tail = F.regexp_replace(tail, r"^[ ,;:-]+|[ ,;:-]+$", "")
        words = F.regexp_extract_all(tail, F.lit(r"\S+"), F.lit(0))
        return F.struct(subject.alias("subject"), verb.alias("predicate"), canonical_name(F.array_join(F.slice(words, 1, 4), " ")).alias("object")).cast(kind)

    # A fold over the text's sentences: each takes its first frame that none before it has taken; later frames aren't worked out.
    def fold(acc: Column, x: Column) -> Column:
        usable = lambda f: (F.length(f["object"]) >= 2) & ~F.lower(f["object"]).isin(STOPWORDS) & ~F.exists(acc, lambda a: a["r"] == f)
        one = lambda v: _let(_let(F.instr(x["low"], v), lambda at: frame(x["low"], x["s"], v, at)), lambda f: F.when(usable(f), f))
        fits = F.array_intersect(F.array(*map(F.lit, VERB_ORDER)), F.split(x["low"], " "))
        first = F.aggregate(fits, F.lit(None).cast(kind), lambda got, v: F.when(got.isNotNull(), got).otherwise(one(v)))
        taken = lambda r: F.when(r.isNotNull(), F.concat(acc, F.array(F.struct(x["position"].alias("position"), x["s"].alias("s"), x["low"].alias("low"), r.alias("r"))))).otherwise(acc)
        return _let(first, taken)

    taken = F.aggregate("_said", F.array().cast(f"array<struct<position:int,s:string,low:string,r:{kind}>>"), fold)
    out = rows.select(*ids, F.explode(taken).alias("x")).select(*ids, "x.position", "x.s", "x.low", "x.r.*")
    dates = out.withColumn("d", find_dates("s"))
    first, last = F.try_element_at("d", F.lit(1)), F.try_element_at("d", F.lit(-1))
    end = lambda f: F.when(F.size("d") > 1, last[f]).when((F.size("d") == 1) & F.col("low").rlike(r"\b(?:before|until|through|to)\b"), first[f])
    return dates.select(*ids, "position", "subject", "predicate", "object", first["day"].alias("valid_from"), end("day").alias("valid_until"), first["label"].alias("start_label"), end("label").alias("end_label"), F.substring("s", 1, 300).alias("sentence"), F.lit(0.55).alias("confidence"))


REPLY = "entities array<struct<id:string,name:string,type:string,aliases:array<string>,sentence:string,confidence:double>>, relations array<struct<subject:string,predicate:string,object:string,validity:struct<start:string,end:string,start_label:string,end_label:string>,sentence:string,confidence:double>>, chunk_temporal struct<start:string,end:string,start_label:string,end_label:string>"


def reply_json(reply) -> Column:
    """A model's reply as JSON text: without code fences, else what lies from the first { to the last }; null if that is
    no JSON either."""
    reply = reply if isinstance(reply, Column) else F.col(reply)
    once = lambda text, then: F.element_at(F.transform(F.array(text), then), 1)
    valid = lambda c: F.try_parse_json(c).isNotNull() & (c != "")
    core = lambda bare: once(F.regexp_extract(bare, r"(?s)\{.*\}", 0), lambda c: F.when(valid(c), c))
    return once(F.trim(F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")), lambda bare: F.when(valid(bare), bare).otherwise(core(bare)))


def reply_date(value) -> Column:
    """A date in a reply: null for empty, null, none and n/a; a time of day is dropped; impossible ones are null."""
    value = F.trim(value if isinstance(value, Column) else F.col(value))
    return F.when(F.lower(value).isin("", "null", "none", "n/a"), None).otherwise(F.try_to_date(F.regexp_extract(value, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$", 1), "yyyy-M-d"))


def reply_relations(replies: DataFrame, ids: list[str], reply: str = "reply") -> DataFrame:
    """The complete relations of replies: blank subjects, predicates or objects are left out, sentences cut to 300."""
    # An outer explode, since from an inner one Spark makes a filter that parses the reply again (and again in a join below it).
    parsed = replies.select(*ids, F.from_json(reply_json(reply), REPLY).alias("r")).select(*ids, F.posexplode_outer("r.relations").alias("position", "x"))
    part = lambda c: F.trim(F.coalesce(F.col(f"x.{c}"), F.lit("")))
    start, end = reply_date(F.col("x.validity.start")), reply_date(F.col("x.validity.end"))
    out = parsed.select(*ids, "position", part("subject").alias("subject"), part("predicate").alias("predicate"), part("object").alias("object"), start.alias("valid_from"), end.alias("valid_until"), F.coalesce("x.validity.start_label", start.cast("string")).alias("start_label"), F.coalesce("x.validity.end_label", end.cast("string")).alias("end_label"), F.substring(part("sentence"), 1, 300).alias("sentence"), F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))
    return out.where("subject != '' AND predicate != '' AND object != ''")


def reply_entities(replies: DataFrame, ids: list[str], reply: str = "reply") -> DataFrame:
    """The named entities of replies."""
    parsed = replies.select(*ids, F.from_json(reply_json(reply), REPLY).alias("r")).select(*ids, F.posexplode_outer("r.entities").alias("position", "x"))
    out = parsed.select(*ids, "position", F.trim("x.name").alias("name"), F.coalesce(F.nullif(F.trim("x.type"), F.lit("")), F.lit("Other")).alias("type"), "x.aliases", F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))
    return out.where(F.coalesce("name", F.lit("")) != "")


def reply_windows(replies: DataFrame, ids: list[str], reply: str = "reply") -> DataFrame:
    """ids, w: the window that a reply gives for its whole text (start, end, start_label, end_label)."""
    x = replies.select(*ids, F.from_json(reply_json(reply), REPLY).alias("r")).select(*ids, "r.chunk_temporal.*")
    start, end = reply_date(F.col("start")), reply_date(F.col("end"))
    label = lambda c, day: F.coalesce(F.nullif(F.trim(f"{c}_label"), F.lit("")), F.when(day.isNotNull(), F.col(c)))
    return x.select(*ids, F.struct(start.alias("start"), end.alias("end"), label("start", start).alias("start_label"), label("end", end).alias("end_label")).alias("w"))
