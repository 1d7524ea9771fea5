"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix on unit bounds and put in another order.

One Aho-Corasick automaton holds the ASCII characters at which units may end and the three sentinels; it passes once over the
text's code points. Units between two of its events are counted by arithmetic: each code point of a gap is a unit ("chars"), or a
gap and the event that closes it are one ("lines"), or a gap and the run of white space behind it ("words"). So the sparse list of
events gives the number of units and the code point at which the k-th unit ends, and a text is cut without being split.

Units: lines `[^\n]*\n|[^\n]+`; words `[^ \t\n\r]*[ \t\n\r]+|[^ \t\n\r]+`; chars, single code points.

The draws come from the id: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of seed + ":" + the id in decimal. Of n
units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger. h3 % 100 decides whether the
text is transformed at all (below `rate`), h4 % 100 between spm (below `spm`) and psm:

    psm: <P> prefix <S> suffix <M> middle        spm: <S> suffix <P> prefix <M> middle

Edge cases: a null or empty text stays plain and comes out empty with 0 units, and a text that holds a sentinel stays plain, since
its output could not be taken apart; prefix, middle or suffix may be empty; a null id draws as the empty string; repeated rows
are rows of their own; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import slices, table, texts

# The sentinels before prefix, suffix and middle, and the characters at which units may end.
SENTINELS = ("<P>", "<S>", "<M>")
ENDS = {"lines": "\n", "words": " \t\n\r", "chars": ""}
SEED, RATE, SPM = 7, 100, 50


class Ranks(NamedTuple):
    """The units of a text: how many there are, and the code points behind the ends of those that events close (None: every
    code point is a unit)."""

    n: int
    ends: list[int] | None
    sentinel: bool
    size: int

    def upto(self, k: int) -> int:
        """The code points that the first k units take."""
        if self.ends is None:
            return k
        return 0 if k == 0 else self.ends[k - 1] if k <= len(self.ends) else self.size


class EventScan:
    """The automaton for a kind of unit and three sentinels."""

    def __init__(self, unit: str = "lines", sentinels: tuple[str, str, str] = SENTINELS):
        if unit not in ENDS:
            raise ValueError(f"unit is one of {', '.join(ENDS)}")
        if len({*sentinels}) < 3 or not all(sentinels) or any(a != b and a in b for a in sentinels for b in sentinels):
            raise ValueError("sentinels are three different strings, none within another")
        self.unit = unit
        self.automaton = ahocorasick.Automaton()
        for key in {*ENDS[unit], *sentinels}:
            # A sentinel that is itself a unit's end counts as a sentinel.
            self.automaton.add_word(key, (len(key), key in sentinels))
        self.automaton.make_automaton()

    def ranks(self, text: str) -> Ranks:
        events, sentinel = [], False
        for at, (_, special) in self.automaton.iter(text):
            if special:
                sentinel = True
            else:
                events.append(at + 1)
        size = len(text)
        if self.unit == "chars":
            return Ranks(size, None, sentinel, size)
        if self.unit == "words":  # a run of white space closes one unit, with its last character
            events = [x for i, x in enumerate(events) if i + 1 == len(events) or events[i + 1] != x + 1]
        open_ = size > (events[-1] if events else 0)
        return Ranks(len(events) + open_, events, sentinel, size)


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of an id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per row of docs: id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    kind = docs.schema[id_col].dataType.simpleString()
    EventScan(unit, sentinels)  # for its errors
    h = draws(F.col(id_col), seed)
    wanted = F.when(h[2] % 100 >= rate, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h[0].alias("h1"), h[1].alias("h2"), wanted.alias("form"))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    before, behind, within = sentinels

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(unit, sentinels)
        for batch in slices(batches, "text"):
            out = []
            for text, h1, h2, form in zip(texts(batch), *(batch.column(c).to_pylist() for c in ("h1", "h2", "form")), strict=True):
                ranks = scan.ranks(text)
                if not text or ranks.sentinel or form == "plain":
                    out.append((ranks.n, "plain", None, None, text))
                    continue
                a, b = sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1)))
                s, e = ranks.upto(a), ranks.upto(b)
                prefix, middle, suffix = text[:s], text[s:e], text[e:]
                made = (before, prefix, behind, suffix) if form == "psm" else (behind, suffix, before, prefix)
                out.append((ranks.n, form, s, e - s, "".join((*made, within, middle))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names=names)

    made = rows.mapInArrow(transformed, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form stand for."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[25:32] AS BIGINT) % 100 AS z FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
QUERIES, ORACLES = {"op12_fill_in_middle": op12_fill_in_middle}, {"op12_fill_in_middle": ORACLE}
