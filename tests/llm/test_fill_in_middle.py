import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from factlens.llm.fill_in_middle import ENDS, ORACLE, EventScan, fill_in_middle, op12_fill_in_middle, restored

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t\n\r]*[ \t\n\r]+|[^ \t\n\r]+", "chars": r"(?s:.)"}
MARKS = ("<P>", "<S>", "<M>")


def brute(id_, text, unit, seed=7, rate=100, spm=50, marks=MARKS):
    """By the units' pattern."""
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digits = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm_first = h[3] % 100 < spm
    out = marks[1] + s + marks[0] + p + marks[2] + m if spm_first else marks[0] + p + marks[1] + s + marks[2] + m
    return len(units), "spm" if spm_first else "psm", len(p), len(m), out


def corpus():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("ab é漢🙂\n\n \t\r<>PSM.") for _ in range(n))
    rows = [say(rng.randrange(60)) for _ in range(150)]
    return [*rows, None, "", "\n", "\n\n\n", "no end", " ", "a <P> b", "x<S>", "<M>", "<<P>>", "<P", "P>", "line\n" * 20_000, "x" * 300_000, " \n" * 5_000, rows[0], rows[0]]


@pytest.mark.parametrize("unit", sorted(ENDS))
def test_by_brute_force(spark, unit):
    rows = list(enumerate(corpus())) + [(None, "one\ntwo\n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'q' AS form", "2 AS h1", "'o' AS output").repartition(3)
    for options in ({}, {"seed": 11, "rate": 60, "spm": 20}, {"marks": ("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")}):
        marks = options.get("marks", MARKS)
        own = {**{k: v for k, v in options.items() if k != "marks"}, "sentinels": marks}
        made = fill_in_middle(docs, unit=unit, **own).withColumn("back", restored(F.col("output"), F.col("form"), marks))
        got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in made.collect()), key=str)
        assert got == sorted(((i, brute(i, t, unit, **options), t or "") for i, t in rows), key=str)


def test_units():
    scan = EventScan("words")
    assert scan.ranks("  ab  c\n").n == 3 and [scan.ranks("  ab  c\n").upto(k) for k in range(4)] == [0, 2, 6, 8]
    assert EventScan("lines").ranks("a\n\nb") == (3, [2, 3], False, 4)
    assert EventScan("chars").ranks("a<S>").sentinel
    for bad in (("a", "a", "b"), ("", "x", "y"), ("<P>", "<P>x", "z")):
        with pytest.raises(ValueError, match="sentinels"):
            EventScan("lines", bad)
    with pytest.raises(ValueError, match="unit"):
        EventScan("pages")


def test_oracle_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = op12_fill_in_middle(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(ORACLE).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")), "doc_id").where("own != restored_sha256").count() == 0
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
