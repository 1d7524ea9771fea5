r"""Secret scans: all rules compiled into one deterministic automaton, run over each text's bytes in one pass.

The combined automaton (subset construction, minimised, transition arrays) has a place for each rule in its state: how far
the rule's openings have come, how long a match's run is, and how many bytes ago it began. So the one pass itself yields
the spans of all rules, per rule leftmost, longest and not overlapping. Matches whose run is shorter than the rule asks for
are dropped, but still take up the text they cover.

Offsets are code points, ends exclusive. Spans of different kinds may overlap. Edge cases: a null text counts as empty
and has no spans (redacting leaves it null); repeated rows are scanned one by one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm.automaton import Automaton, Rule, compile_rules
from factlens.llm.common import slices, table

BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
)
#: What the method adds to the base rules.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("key", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Scanner:
    """Finds the rules' spans in a text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.all = rules, compile_rules(rules)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of all spans, sorted."""
        data = text.encode()
        found = self.all.spans(data)
        if found and len(data) != len(text):
            found = [(len(data[:s].decode()), i, len(data[:e].decode())) for s, i, e in found]
        return sorted(found)


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """text with each span (overlapping ones as one, named by the first) replaced by its kind in brackets."""
    out, at, merged = [], 0, []
    for s, i, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, i, e])
    for s, i, e in merged:
        out += [text[at:s], f"[{rules[i].kind}]"]
        at = e
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and `spans`, an array of (kind, start, end) by start, then by the rules' order."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = scanner(rules)
        for batch in slices(batches, text_col):
            rows = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in finder.spans(x)] if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, spans {SPANS}")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret in text_col replaced by its kind in brackets; length_col, if docs has it, follows."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = scanner(rules)
        for batch in slices(batches, text_col):
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [redacted(x, found, rules) if x and (found := finder.spans(x)) else x for x in old]
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                kept = cols[size].to_pylist()
                cols[size] = pa.array([k if a is b or a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(scan, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


QUERIES, ORACLES = {"op5_secret_scans": op5_secret_scans}, {}
__all__ = ["BASE", "MORE", "RULES", "Automaton", "Rule", "Scanner", "find_secrets", "op5_secret_scans", "redact_secrets"]
