"""URL filters: one broadcast trie over reversed host labels and path segments, longest match wins.

A rule is (verdict, host, path): it fits the host itself and every subdomain, if the URL's path starts with the
rule's path. Of the fitting rules the one with the most host labels wins, then the one with the longest path; of
allow and block entries at the same place, allow wins. URLs without a fitting rule get the operator's default verdict.

Edge cases: a null URL or one without `://` has an empty host and path, which no rule fits (default verdict); an
empty path fits only rules with an empty path; repeated rows are judged one by one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factlens.llm.common import table

#: The trie goes to every task, so the rules' number is checked against this bound.
MAX_RULES = 2_000_000
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The production rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower
    case; the path goes on from there up to `?`, `#` or the end."""
    rest = (url or "").partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path




class Trie:
    """Nodes are dicts. A host node leads by (label,), from the right, to host nodes; its "paths" is the root of the paths
    under that host, where (segment,) leads on for a segment that a slash ends and "rules" lists (open tail, rule)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault((label,), {})
            node = node.setdefault("paths", {})
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.setdefault((segment,), {})
            node.setdefault("rules", []).append((tail, rule))

    def match(self, host: str, path: str) -> Rule | None:
        """The rule that fits (host, path) and goes deepest, or None."""
        if not host:
            return None
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get((label,))
            if node is None:
                break
            if "paths" in node and (best := self._longest(node["paths"], path)):
                found = best
        return found

    @staticmethod
    def _longest(node: dict, path: str) -> Rule | None:
        best, segments, at = None, path.split("/"), 0
        while True:
            for tail, rule in node.get("rules", ()):
                if segments[at].startswith(tail):
                    longer = best is None or len(rule.path) > len(best.path)
                    if longer or len(rule.path) == len(best.path) and rule.verdict == "allow":
                        best = rule
            if at == len(segments) - 1:
                return best
            node = node.get((segments[at],))
            if node is None:
                return best
            at += 1


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id_col, host, path, rule (null if none fits), verdict.

    The rules are checked to number MAX_RULES at most, as the trie goes to every task; more of them raise ValueError.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: above {MAX_RULES} the trie is too large to broadcast")
    kind = pages.schema[id_col].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            found = [trie.match(*x) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in parts], pa.string()),
                    pa.array([x[1] for x in parts], pa.string()),
                    pa.array([r and r.name for r in found], pa.string()),
                    pa.array([r.verdict if r else default for r in found], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    return pages.select(id_col, url_col).mapInArrow(judge, schema)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
QUERIES, ORACLES = {"op10_url_filters": op10_url_filters}, {"op10_url_filters": ORACLE}
