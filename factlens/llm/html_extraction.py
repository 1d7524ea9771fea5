"""HTML extraction by consensus host paths.

1. Each page's containers get a score: the characters of running text below them that lie in no link and no boilerplate,
   weighted by what the container's tag and classes say. The best container's generalised tag-class path (digits become
   #, ids are left out) is the page's vote.
2. The votes are counted per host and path in Spark (pre-aggregated, so a host with a third of all pages is no burden);
   a host's path with most votes, then most characters, then first by name, wins.
3. Every page is extracted again with its host's path; a page that lacks it uses its own best container.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line break in page order. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out; nothing else is. Elements that are these by tag or role, or are hidden, go. Blocks that are these by
a class or id go too, unless they hold MOST of the page's text (and none is marked as main text elsewhere) or have the winning path: the whole of a class or id has to
say so (`ad`), or its first or last part (`site-header`, `comment-list`) where the other part doesn't say that something
else merely has one (`has-sidebar`). Headings, paragraphs and inline elements go only by a whole class or id.

A page is read in time in proportion to its length: tags without an end, stray end tags and deep nesting included.

Edge cases: null or empty html gives an empty text; a null URL's page counts to the host ''; markup without any
container counts as the body; unclosed tags end with their parent or the page; repeated rows are extracted one by one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import saved, slices, table

#: Up to so many hosts the winning paths are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000
#: The share of a page's text that shows a container to be no boilerplate, whatever its classes say.
MOST = 0.8
#: Beyond that bound a host's pages are dealt over a join key for each SALT of them (the largest hosts, as many as the bound).
SALT = 50_000

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center dd div dl fieldset figure li main ol section table tbody td tr ul".split())
INLINE = frozenset("p span a b i em strong small h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("aside button dialog footer form head header menu nav select".split())
# Words in class, id or role that mark boilerplate, and such as mark the main text.
OUT = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe taboola toolbar widget widgets".split())
HAVING = frozenset("has have with without no not is in show hide open close below above after before".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN = frozenset("article articlebody body content entry main post story text".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_PLAIN = re.compile(r"[^'\">]*")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[-_.:]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class _Said(NamedTuple):
    """What an element's attributes say of it."""

    classes: list[str]  # generalised
    main: bool
    out: bool  # a part of a class or id marks boilerplate
    plainly: bool  # a whole class or id does
    gone: bool  # hidden, or boilerplate by its role


_NOTHING = _Said([], False, False, False, False)


def _said(attributes: str) -> _Said:
    return _known(attributes) if len(attributes) < 1000 else _known.__wrapped__(attributes)


@lru_cache(maxsize=20_000)
def _known(attributes: str) -> _Said:
    main = out = plainly = gone = False
    classes: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            gone = True
        elif key == "style":
            gone = gone or "display:none" in value.lower().replace(" ", "")
        elif key == "role":
            gone = gone or value.strip().lower() in ROLES
            main = main or value.strip().lower() in MAIN
        else:
            for token in value.split():
                parts = [x.lower() for x in _PART.split(_DIGITS.sub("", token)) if x]
                main = main or not MAIN.isdisjoint(parts)
                if key == "class":
                    classes.add(_DIGITS.sub("#", token.lower()))
                if key != "itemprop" and parts:
                    plainly = plainly or len(parts) == 1 and parts[0] in OUT
                    out = out or HAVING.isdisjoint(parts) and (parts[0] in OUT or parts[-1] in OUT)
    return _Said(sorted(classes), main, out, plainly, gone)


class _Tags:
    """The tags of a page, found in one pass whatever the page looks like: behind the last `>` there is none, and where a tag's
    quotes leave no end for it, that is remembered, so that no later tag goes the same way again."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes = {q: source.rfind(q) for q in "'\""}
        self.dead: set[int] = set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The first tag from a place on: start, end, whether it closes, name ('' for comments and the like), attributes."""
        m = _OPEN.search(self.source, at, self.last + 1)
        if m is None:  # a comment needs no end
            start = self.source.find("<!--", at)
            return None if start < 0 else (start, len(self.source), False, "", "")
        if m[1]:
            end = self.source.find("-->", m.end())
            return m.start(), len(self.source) if end < 0 else end + 3, False, "", ""
        end = -1 if m[2] else self._end(m.end())
        end = end if end >= 0 else self.source.find(">", m.end())
        return m.start(), end + 1, bool(m[3]), (m[4] or "").lower(), self.source[m.end() : end] if m[4] else ""

    def _end(self, at: int) -> int:
        """Where the first `>` outside of quotes is; -1 if there is none."""
        opened: list[int] = []
        while True:
            if at <= self.last:
                at = _PLAIN.match(self.source, at, self.last + 1).end()
            if at <= self.last and self.source[at] == ">":
                return at
            if at > self.last or at in self.dead or self.quotes[self.source[at]] <= at:
                self.dead.update(opened, [at])
                return -1
            opened.append(at)
            at = self.source.find(self.source[at], at + 1) + 1


class Page:
    """A page's containers and text blocks, read in one pass over its tags."""

    def __init__(self, source: str):
        # A container's own part of its path, and the number of the path; equal paths of a page have equal numbers.
        self.parts: list[str] = ["body"]
        self.path_ids: list[int] = [0]
        self.parents: list[int] = [-1]
        self.weights: list[float] = [0.5]
        self.doubtful: list[bool] = [False]  # boilerplate by a class or id
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters outside links
        self._read(source)

    def _read(self, source: str) -> None:
        # The stack holds (tag, container that holds while it is open, in boilerplate, in a link).
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        opened: Counter[str] = Counter()
        path_ids: dict[tuple[int, str], int] = {}
        tags = _Tags(source)
        parts: list[str] = []
        linked = at = 0

        def end_block() -> None:
            nonlocal linked
            if parts:
                if text := " ".join(html.unescape("".join(parts)).split()):
                    self.blocks.append((text, stack[-1][1], max(0, len(text) - linked)))
                parts.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            _, _, out, link = stack[-1]
            if piece and not out:
                parts.append(piece)
                linked += len(piece) * link

        def close(depth: int) -> None:
            for x in stack[depth:]:
                opened[x[0]] -= 1
            del stack[depth:]

        size = len(source)
        while at < size:
            tag = tags.after(at)
            if tag is None:
                add(source[at:])
                break
            start, end, closing, name, attributes = tag
            add(source[at:start])
            at = end
            if not name:
                continue
            if name in BLOCKS:
                end_block()
            elif name == "br":
                add(" ")
            if closing:
                if opened[name] > 0:
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                    end_block() if name in BLOCKS or name in BOILERPLATE else None
                    close(k)
                continue
            if name in RAW:
                if not attributes.endswith("/"):
                    found = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at, tags.last + 1)
                    at = found.end() if found else size
                continue
            if name in VOID or attributes.endswith("/") and name not in CONTAINERS:
                continue
            if name in BLOCKS and stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in ("li", "td", "th", "tr", "dd", "dt") and stack[-1][0] == name:
                close(len(stack) - 1)
            _, box, out, link = stack[-1]
            if name in ("html", "body"):
                continue
            said = _said(attributes) if attributes else _NOTHING
            bad = said.gone or name in BOILERPLATE or said.plainly and name in INLINE
            if bad and not out:
                end_block() if name in BLOCKS else None
            out = out or bad
            if name in CONTAINERS and not out:
                part = name + "".join(f".{x}" for x in said.classes)
                self.parts.append(part)
                self.path_ids.append(path_ids.setdefault((self.path_ids[box], part), len(path_ids) + 1))
                self.parents.append(box)
                self.weights.append(4.0 if name == "article" else 3.0 if name == "main" or said.main else 1.0)
                self.doubtful.append(said.out)
                box = len(self.parts) - 1
            if name in CONTAINERS or name in BOILERPLATE or name in ("p", "a", "dt", "th") or bad:
                stack.append((name, box, out, link or name == "a"))
                opened[name] += 1
        end_block()

    def _settle(self) -> list[int]:
        """Decide which doubtful containers are boilerplate: those that hold less than MOST of the page's text (outside
        links), and all if the main text is marked elsewhere. Returns the characters below each container, without those in boilerplate."""
        own = [0] * len(self.parts)
        for _, box, n in self.blocks:
            own[box] += n
        below = own[:]
        for i in range(len(below) - 1, 0, -1):
            below[self.parents[i]] += below[i]
        beneath = self.doubtful[:]
        for i in range(1, len(own)):
            beneath[i] = beneath[i] or beneath[self.parents[i]]
        # Where the page marks its main text elsewhere, no doubt is left.
        marked = any(w > 1 and n and not bad for w, n, bad in zip(self.weights, below, beneath, strict=True))
        self.cut = [doubtful and (marked or below[i] < MOST * below[0]) for i, doubtful in enumerate(self.doubtful)]
        for i in range(len(own) - 1, 0, -1):
            if not self.cut[i]:
                own[self.parents[i]] += own[i]
        return own

    def _best(self) -> tuple[int, int]:
        """The container with the highest score, and the characters below it."""
        chars = self._settle()
        out = [False] * len(chars)
        for i in range(1, len(chars)):
            out[i] = self.cut[i] or out[self.parents[i]]
        i = max((k for k, gone in enumerate(out) if not gone), key=lambda k: (chars[k] * self.weights[k], k))
        return i, chars[i]

    def best(self) -> tuple[str, int]:
        """The path of that container, and the characters below it."""
        i, chars = self._best()
        parts = []
        while i >= 0:
            parts.append(self.parts[i])
            i = self.parents[i]
        return "/".join(reversed(parts)), chars

    def _having(self, path: str | None) -> set[int]:
        """The number of a path in this page, if it has it."""
        # For each container whose path begins the wanted one, how many characters of it.
        upto = [len("body") if path and path.startswith("body") else -1]
        for part, parent in zip(self.parts[1:], self.parents[1:], strict=True):
            n = upto[parent]
            upto.append(n + 1 + len(part) if n >= 0 and path.startswith("/" + part, n) else -1)
        return {k for k, n in zip(self.path_ids, upto, strict=True) if path is not None and n == len(path)}

    def text(self, path: str | None) -> str:
        """The text below the containers with that path, or below the page's own best container if it has none."""
        best, _ = self._best()
        wanted = self._having(path) or {self.path_ids[best]}
        inside: list[bool] = []
        for i, (own, parent) in enumerate(zip(self.path_ids, self.parents, strict=True)):
            inside.append(own in wanted or parent >= 0 and inside[parent] and not self.cut[i])
        return "\n".join(text for text, box, _ in self.blocks if inside[box])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host the path that wins the vote: host, path, pages (votes in all)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [Page(x).best() if x else (None, 0) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, "host string, path string, chars long").where("chars > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    # The order of a struct that is largest for most votes, then most characters, then the first name.
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path")).alias("b"), F.sum("votes").alias("pages"))
    return best.select("host", F.col("b.path").alias("path"), "pages")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_hosts: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """One row per row of pages: id_col, url, text, n_chars (code points)."""
    kind = pages.schema[id_col].dataType.simpleString()
    winners = saved(winning_paths(pages, url_col=url_col, html_col=html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if winners.count() <= max_hosts:
        rows = rows.join(F.broadcast(winners.select("host", "path")), "host", "left")
    else:
        # A host gets a salt for each SALT of its pages with text.
        salts = winners.select("host", "path", F.ceil(F.col("pages") / SALT).cast("int").alias("salts"))
        hot = F.broadcast(salts.where("salts > 1").orderBy(F.desc("salts"), "host").limit(max_hosts).select("host", "salts"))
        rows = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("url", "id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        dealt = salts.drop("salts").join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        rows = rows.join(dealt, ["host", "salt"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [Page(x).text(path) if x else "" for x, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return rows.select("id", "url", "html", "path").mapInArrow(extract, f"`{id_col}` {kind}, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES, ORACLES = {"op4_html_extraction": op4_html_extraction}, {}
