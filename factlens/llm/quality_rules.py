r"""Quality rules by distribution divergence, in DataFrame functions only.

Base figures: words are runs of `[^\x20\x09-\x0D]`; a document fails the base rules with fewer than 10 words, or if over
20 % of its words lie in five-word windows that the text holds twice or more.

Method: a document's histogram of character classes and its histogram of common words are compared with those of each
language reference by Jensen-Shannon distance (base 2, 0 to 1). The language whose references are nearest counts, so the
lang column of a judged document is never read. Documents shorter than a guard are not judged by that histogram: too few
characters or words say nothing about a distribution.

References are fitted by `fit_references` on rows labelled as good, whole texts: for the pipeline on all of them, of all
languages; for op9, whose SQL says so, on a bounded sample of SAMPLE_ROWS a language, in the order of the MD5 of their ids, and
MAX_LANGUAGES languages. A language without such rows (or with under MIN_SAMPLE_WORDS words of them) has the shares given
here, if any. The limits keep 99.9 % of the good rows at sf0.1 that the references haven't seen.

Edge cases: a null or empty text has no words (base_failed); a text of white space too; repeated rows are judged one by
one; extra columns are not read. Labelled rows without an id, a language or a document are not fitted on; rows that share an
id and a language are sampled together; without labels all references are the ones given here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm.common import saved, table

SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Minimum-length guards: characters for the class histogram, words for the common-word histogram.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Largest distances to the nearest language that a kept document may have.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.30
#: Of the references: sampled rows a language, words that a language needs in them, its common words, languages at most.
SAMPLE_ROWS, MIN_SAMPLE_WORDS, REFERENCE_WORDS, MAX_LANGUAGES = 300, 1_000, 16, 32
#: Labelled ids that are sent to all tasks when all rows are fitted on; with more, texts and ids are joined by a shuffle.
MOST_SENT_IDS = 1_000_000
#: Parts in which a language's ids are ranked before they are ranked as one.
SALTS = 64
#: What follows a word without being part of it.
STOPS = ".,;:!?"

#: Character classes as regular expressions; what none of them holds is the last class.
CLASSES = (("lower", r"\p{Ll}"), ("space", r"[ \t-\r]"), ("upper", r"\p{Lu}"), ("digit", r"[0-9]"), ("stop", r"[.,;:!?'\"()-]"))

# Shares of the character classes (lower, space, upper, digit, stop, other) in plain prose.
CLASS_SHARES = {
    "en": (0.780, 0.165, 0.025, 0.005, 0.024, 0.001),
    "de": (0.780, 0.135, 0.055, 0.005, 0.024, 0.001),
    "fr": (0.780, 0.160, 0.025, 0.005, 0.029, 0.001),
    "es": (0.785, 0.165, 0.022, 0.005, 0.022, 0.001),
}
# Common words of each language with their shares of all words of plain prose, in per mille.
COMMON_WORDS = {
    "en": {"the": 60, "of": 30, "and": 28, "to": 26, "a": 22, "in": 20, "is": 11, "that": 11, "it": 10, "for": 9},
    "de": {"der": 33, "die": 33, "und": 26, "in": 18, "den": 12, "von": 11, "zu": 11, "das": 10, "mit": 9, "ist": 8},
    "fr": {"de": 55, "la": 33, "le": 27, "et": 25, "les": 22, "des": 18, "en": 16, "un": 14, "du": 13, "une": 13},
    "es": {"de": 60, "la": 38, "que": 30, "el": 29, "en": 27, "y": 26, "a": 20, "los": 17, "del": 12, "se": 12},
}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: functions of arrays would work it out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """How many words lie in five-word windows whose words the text holds twice or more (as 64-bit hashes)."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull()))

    def slow(wh: Column) -> Column:
        return let(let(F.sort_array(F.transform(wh, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice), covered)

    some = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda wh: F.when(F.size(F.array_distinct(wh)) == F.size(wh), 0).otherwise(slow(wh)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(some)


def _distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) between the counts' shares of total and the reference shares."""

    def part(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return (F.when(c > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + q * F.log2(q / m)) / 2

    parts = F.zip_with(counts, F.array(*map(F.lit, shares)), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def _least(values: list[Column]) -> Column:
    return F.array_min(F.array(*values))


def _rest(counts: Column, total: Column) -> Column:
    """counts and, last, what is left of total, as doubles."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)))


#: A language's shares of the character classes, and its common words with their shares of all words.
Reference = tuple[list[float], dict[str, float]]


def given_references() -> dict[str, Reference]:
    """The references that stand in this module."""
    return {lang: ([x / sum(CLASS_SHARES[lang]) for x in CLASS_SHARES[lang]], {w: x / 1000 for w, x in words.items()}) for lang, words in COMMON_WORDS.items()}


def fit_references(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int | None = SAMPLE_ROWS, words: int = REFERENCE_WORDS, languages: int | None = MAX_LANGUAGES) -> dict[str, Reference]:
    """References by language from the labelled rows (quality 1), and the given ones for other languages: from a sample of
    `rows` a language, or from all if that is None, and likewise for `languages`. What comes to the driver is bounded by
    languages and words."""
    good = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.coalesce(text_col, F.lit("")).alias("_text")).where("_lang IS NOT NULL")
    with_words = lambda df: df.select("_lang", "_text", _words(F.col("_text")).alias("_words"))
    if rows is None:
        # Read twice, for the totals and for the words, rather than written.
        sample = with_words(texts.join(F.broadcast(good) if good.count() <= MOST_SENT_IDS else good, "_id", "left_semi"))
    else:
        sample = saved(with_words(texts.join(F.broadcast(_sampled_ids(texts.select("_id", "_lang"), good, rows)), ["_id", "_lang"])))
    counted, classes = _classes(sample)
    sums = [F.sum(c).alias(f"c{i}") for i, c in enumerate(classes)]
    totals = counted.groupBy("_lang").agg(F.sum(F.size("_words")).alias("n"), F.sum(F.length("_text")).alias("chars"), *sums)
    totals = totals.where(F.col("n") >= MIN_SAMPLE_WORDS).orderBy(F.desc("n"), "_lang")
    totals = (totals if languages is None else totals.limit(languages)).collect()
    word = F.lower(F.rtrim("word", F.lit(STOPS)))
    counts = sample.select("_lang", F.explode("_words").alias("word")).select("_lang", word.alias("word")).where(F.col("word").rlike(r"^\p{L}+$")).groupBy("_lang", "word").count()
    best = Window.partitionBy("_lang").orderBy(F.desc("count"), "word")
    top: dict[str, dict[str, int]] = {t["_lang"]: {} for t in totals}
    listed = counts.where(F.col("_lang").isin(list(top))).withColumn("place", F.row_number().over(best)).where(F.col("place") <= words)
    for r in listed.orderBy("_lang", "place").collect():
        top[r["_lang"]][r["word"]] = r["count"]
    out = given_references()
    for t in totals:
        if common := top[t["_lang"]]:
            # One more than was counted, so that no share is zero.
            of = [t[f"c{i}"] for i in range(len(CLASSES))]
            shares = [(x + 1) / (t["chars"] + len(of) + 1) for x in [*of, t["chars"] - sum(of)]]
            out[t["_lang"]] = shares, {w: k / (t["n"] + 1) for w, k in common.items()}
    return out


def _sampled_ids(named: DataFrame, good: DataFrame, rows: int) -> DataFrame:
    """_id, _lang: the first `rows` good ids of each language. Ids are joined and ranked, so texts are read for the sample alone."""
    ids = named.join(good, "_id").distinct().withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    # The first of each salt before the first of all: a language that most rows have isn't ranked in one task.
    for keys in (["_lang", "_salt"], ["_lang"]):
        order = Window.partitionBy(*keys).orderBy(F.md5(F.col("_id").cast("string")), "_id")
        ids = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).drop("_rank")
    return ids.drop("_salt")


def _classes(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with columns that its _text becomes when classes are taken out one by one, and each class's characters."""
    # Each class is taken out of what the classes before it left, so all but the first see short texts.
    left = [f"_left{i}" for i in range(len(CLASSES) + 1)]
    df = df.withColumn(left[0], F.col("_text"))
    for (_, rx), before, after in zip(CLASSES, left, left[1:], strict=False):
        df = df.withColumn(after, F.regexp_replace(before, f"{rx}+", ""))
    return df, [F.length(a) - F.length(b) for a, b in zip(left, left[1:], strict=False)]


def judge_quality(docs: DataFrame, references: dict[str, Reference] | None = None, *, id_col: str = "doc_id", text_col: str = "text", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, keep: bool = False) -> DataFrame:
    """One row per row of docs: id_col, the base figures, base_failed, class_distance and word_distance (null under the
    guards) to the nearest language of the references (the given ones, if none), kept; with keep, also the whole input row as
    struct `input`."""
    references = references or given_references()
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input")] if keep else []
    base = docs.select(F.col(id_col), text.alias("_text"), *whole)
    base = base.withColumn("_words", _words(F.col("_text")))
    lines = let(F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    base, classes = _classes(base)
    listed = sorted({w for _, words in references.values() for w in words})
    figures = base.select(
        id_col,
        *["input"] * keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(f"_left{len(CLASSES)}", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.length("_text").alias("_chars"),
        F.array(*[x.cast("double") for x in classes]).alias("_classes"),
        _common(F.col("_text"), listed).alias("_common"),
    )
    chars, n = F.col("_chars").cast("double"), F.col("n_words").cast("double")
    by_class = let(_rest(F.col("_classes"), chars), lambda c: _least([_distance(c, chars, shares) for shares, _ in references.values()]))

    def by_lang(counts: Column, words: dict[str, float]) -> Column:
        own = F.transform(F.array(*[F.lit(listed.index(w)) for w in words]), lambda i: F.get(counts, i))
        return _distance(_rest(own, n), n, [*words.values(), 1 - math.fsum(words.values())])

    def counted(common: Column) -> Column:
        marked = F.array(*[F.lit(f",{w},") for w in listed])
        return F.transform(marked, lambda w: (F.length(common) - F.length(F.replace(common, w, F.lit("")))) / F.length(w))

    by_word = let(let(F.col("_common"), counted), lambda c: _least([by_lang(c, words) for _, words in references.values()]))
    judged = figures.withColumns({
        "class_distance": F.when(F.col("_chars") >= GUARD_CHARS, by_class),
        "word_distance": F.when(F.col("n_words") >= GUARD_WORDS, by_word),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return judged.withColumn("kept", ~F.col("base_failed") & near).drop("_chars", "_classes", "_common")


def _common(text: Column, listed: list[str]) -> Column:
    """The listed words that stand in the text, in any case and with or without stops after them, each between commas."""
    # By first letter, so that most words are left after one comparison a letter.
    by_letter = "|".join(f"{c}(?:{'|'.join(w[1:] for w in listed if w[0] == c)})" for c in sorted({w[0] for w in listed}))
    rx = rf"(?iu)(?<![^ \t-\r])(?:{by_letter})(?=[{STOPS}]*(?:[ \t-\r]|\z))"
    return F.lower(F.concat(F.lit(","), F.array_join(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), ",,"), F.lit(",")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge_quality(docs, fit_references(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """DuckDB SQL for op9_quality_rules; it fits the references too."""

    def distance(counts: str, total: str, shares: str) -> str:
        p, q = f"(z[1] / {total})", "z[2]"
        part = f"(CASE WHEN z[1] > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + {q} * log2({q} / (({p} + {q}) / 2))) / 2"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({counts}, {shares}), lambda z: {part}))))"

    seen = [f"c{i}" for i in range(len(CLASSES))]
    every = [*seen, "c_rest"]
    classes = ", ".join(f"CAST(length(regexp_replace(t, '[^{rx.strip('[]').replace(chr(39), chr(39) * 2)}]', '', 'g')) AS DOUBLE) AS c{i}" for i, (_, rx) in enumerate(CLASSES))
    given = " UNION ALL ".join(f"SELECT '{lang}', {shares!r}, {list(words)!r}, {[*words.values()]!r}" for lang, (shares, words) in given_references().items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 5)),
dup AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT q) AS r FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM dup) GROUP BY rid),
f AS (
  SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, CAST(length(t) AS DOUBLE) AS chars, CAST(len(ws) AS DOUBLE) AS n, {classes},
    list_transform(ws, lambda x: lower(rtrim(x, '{STOPS}'))) AS low
  FROM d LEFT JOIN rep USING (rid)
), g AS (SELECT *, chars - {' - '.join(seen)} AS c_rest, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
good AS (SELECT DISTINCT g.lang, g.doc_id FROM g JOIN labels l ON l.doc_id = g.doc_id WHERE l.quality = 1 AND g.lang IS NOT NULL),
ids AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= {SAMPLE_ROWS}),
sample AS (SELECT g.* FROM g JOIN ids USING (lang, doc_id)),
totals AS (
  SELECT lang, sum(n) AS n, sum(chars) AS chars, {', '.join(f'sum({c}) AS {c}' for c in every)}
  FROM sample GROUP BY lang HAVING sum(n) >= {MIN_SAMPLE_WORDS} ORDER BY sum(n) DESC, lang LIMIT {MAX_LANGUAGES}
), top AS (
  SELECT lang, w, count(*) AS k FROM (SELECT lang, unnest(low) AS w FROM sample) WHERE regexp_full_match(w, '\p{{L}}+')
  GROUP BY lang, w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= {REFERENCE_WORDS}
), fitted AS (
  SELECT lang, [{', '.join(f'(any_value({c}) + 1) / (any_value(chars) + {len(every)})' for c in every)}] AS cs,
    list(w ORDER BY k DESC, w) AS rw, list(k / (n + 1) ORDER BY k DESC, w) AS rs
  FROM totals JOIN top USING (lang) GROUP BY lang
), given(lang, cs, rw, rs) AS ({given}),
refs AS (SELECT cs, rw, list_append(rs, 1 - list_sum(rs)) AS rs FROM (SELECT * FROM fitted UNION ALL SELECT * FROM given WHERE lang NOT IN (SELECT lang FROM fitted))),
own AS (SELECT rid, n, rs, list_transform(rw, lambda w: CAST(len(list_filter(low, lambda x: x = w)) AS DOUBLE)) AS k FROM g, refs WHERE n_words >= {GUARD_WORDS}),
by_word AS (SELECT rid, min({distance('list_append(k, n - list_sum(k))', 'n', 'rs')}) AS word_distance FROM own GROUP BY rid),
by_class AS (SELECT rid, min({distance(f"[{', '.join(every)}]", 'chars', 'cs')}) AS class_distance FROM g, refs WHERE chars >= {GUARD_CHARS} GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM g LEFT JOIN by_word USING (rid) LEFT JOIN by_class USING (rid)
"""


QUERIES, ORACLES = {"op9_quality_rules": op9_quality_rules}, {"op9_quality_rules": _oracle()}
