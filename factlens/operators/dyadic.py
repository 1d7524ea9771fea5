"""Overlap of intervals by dyadic decomposition.

Days are the leaves of a binary tree. An interval is the union of at most two nodes a level, its cover; a day lies in an interval if
exactly one of the day's ancestors is in the cover. Two intervals overlap if the second starts within the first, or the first
starts within the second after the second's start, never both. So each pair meets in one node of one of two equi-joins, an
interval gives at most 2 log2(days) rows and a start log2(days) + 1, and an open end is an end like any other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions import interval as iv

#: Up to so many nodes with their counts are broadcast; trees of up to 2 ** 20 days never have more.
MAX_BROADCAST_NODES = 1 << 21
#: A row is compared with all rows of its key on the right side, if these are not more than so many.
MOST_OF_A_KEY = 1000


class Tree:
    """The days from `first` to `last`, in a tree with `levels` levels above its leaves. Nodes are numbered as in a heap."""

    def __init__(self, first: date, last: date):
        self.first = first
        self.levels = max(1, (last - first).days.bit_length())

    @classmethod
    def over(cls, *sides: tuple[DataFrame, str, str]) -> Tree:
        """The tree over the days of some tables' interval columns."""
        found = [df.agg(F.min(F.least(s, e)).alias("a"), F.max(F.greatest(s, e)).alias("b")).first() for df, s, e in sides]
        low, high = [r.a for r in found if r.a], [r.b for r in found if r.b]
        return cls(min(low), max(high)) if low else cls(date(1970, 1, 1), date(1970, 1, 1))

    def start(self, c) -> Column:
        """A start's leaf; an open one is the first day."""
        return F.coalesce(F.datediff(c, F.lit(self.first)), F.lit(0))

    def end(self, c) -> Column:
        return F.coalesce(F.datediff(c, F.lit(self.first)), F.lit((1 << self.levels) - 1))

    def ancestors(self, leaf: Column) -> Column:
        """The nodes above a leaf, itself included."""
        return F.array(*[F.lit(1 << (self.levels - h)) + F.shiftright(leaf, h) for h in range(self.levels + 1)])

    def cover(self, first: Column, last: Column) -> Column:
        """The fewest nodes whose leaves are those from first to last (none if last is before first)."""
        nodes = []
        for h in range(self.levels + 1):
            # The level's nodes that lie inside are those from low to below high; a parent takes all but odd ones at the ends.
            low, high, base = F.shiftright(first + ((1 << h) - 1), h), F.shiftright(last + 1, h), F.lit(1 << (self.levels - h))
            rest = low + low % 2
            nodes += [F.when((low % 2 == 1) & (low < high), base + low), F.when((high % 2 == 1) & (rest < high), base + high - 1)]
        return F.array_compact(F.array(*nodes))


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, *, on: list[str] = (), tree: Tree | None = None) -> DataFrame:
    """All pairs of rows whose intervals overlap (and whose columns `on` are equal), each once. Columns of the two sides other than
    `on` have different names. With `on`, only keys with more than MOST_OF_A_KEY rows on the right go by nodes."""
    if on:
        large = right.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_OF_A_KEY).select(*on)
        found = large.count()
        small = lambda df: df.join(large, [*on], "left_anti") if found else df
        pairs = small(left).join(small(right), [*on]).where(iv.overlaps(ls, le, rs, re))
        if not found:
            return pairs
        return pairs.unionByName(_by_nodes(left.join(large, [*on], "left_semi"), right.join(large, [*on], "left_semi"), ls, le, rs, re, on, tree))
    return _by_nodes(left, right, ls, le, rs, re, on, tree)


def _by_nodes(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, on: list[str], tree: Tree | None) -> DataFrame:
    tree = tree or Tree.over((left, ls, le), (right, rs, re))
    a = left.withColumns({"_ls": tree.start(ls), "_le": tree.end(le)})
    b = right.withColumns({"_rs": tree.start(rs), "_re": tree.end(re)})
    by = ["_node", *on]
    # Spark takes a side for as large as it was before its explode, so without the hint it would broadcast what it shouldn't.
    inside = a.withColumn("_node", F.explode(tree.cover(F.col("_ls"), F.col("_le")))).join(b.withColumn("_node", F.explode(tree.ancestors(F.col("_rs")))).hint("merge"), by)
    around = a.withColumn("_node", F.explode(tree.ancestors(F.col("_ls")))).join(b.withColumn("_node", F.explode(tree.cover(F.col("_rs") + 1, F.col("_re")))).hint("merge"), by)
    # For intervals that end before they start the condition asks for more than the nodes do.
    return inside.unionByName(around).where(iv.overlaps(ls, le, rs, re)).drop("_node", "_ls", "_le", "_rs", "_re")


def overlap_counts(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, *, on: list[str] = (), tree: Tree | None = None) -> DataFrame:
    """left with n: how many rows of right its interval overlaps (and whose columns `on` are equal). No pair is made: starts and covers
    of right are counted by node, and each different interval of left adds up its nodes. Intervals that end before they start
    overlap nothing."""
    tree = tree or Tree.over((left, ls, le), (right, rs, re))
    right = right.select(*on, tree.start(rs).alias("_s"), tree.end(re).alias("_e")).where("_s <= _e").groupBy(*on, "_s", "_e").agg(F.count("*").alias("_n"))
    rows = left.withColumns({"_s": tree.start(ls), "_e": tree.end(le)})
    own = rows.select(*on, "_s", "_e").distinct()
    by = ["_node", *on]
    total = None
    for mine, theirs in (
        (tree.cover(F.col("_s"), F.col("_e")), tree.ancestors(F.col("_s"))),
        (F.when(F.col("_s") <= F.col("_e"), tree.ancestors(F.col("_s"))), tree.cover(F.col("_s") + 1, F.col("_e"))),
    ):
        nodes = right.withColumn("_node", F.explode(theirs)).groupBy(*by).agg(F.sum("_n").alias("_n"))
        # Without further columns the nodes are those of the calendar.
        nodes = F.broadcast(nodes) if not on and 1 << (tree.levels + 1) <= MAX_BROADCAST_NODES else nodes
        some = own.withColumn("_node", F.explode(mine)).join(nodes, by).select(*on, "_s", "_e", "_n")
        total = some if total is None else total.unionByName(some)
    sums = total.groupBy(*on, "_s", "_e").agg(F.sum("_n").alias("n"))
    return rows.join(sums, [*on, "_s", "_e"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("_s", "_e")
