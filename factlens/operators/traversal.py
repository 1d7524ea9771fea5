"""Traversals: which names lie how far from a start, and the edges that they touch.

A traversal reads edges from a source. `Scan` reads an edge table, once a hop. `Adjacency` reads a stored table that holds each
edge under both of its ends, in folders by the hash of the end's canonical key and sorted by the key inside, so a hop reads the
folders of the names it starts from, and of these the row groups that may hold them. Nothing is cached: names are few and go to
the driver (MAX_LOCAL at most), or else they are written to the shared folder, and the edges are read once more at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.text import canonical_key
from factlens.sources.scratch import new_folder, saved

#: Folders of a stored adjacency. Tables written with another number can't be read together.
BUCKETS = 64
#: Names of one distance that the driver holds; beyond, they stay in the shared folder.
MAX_LOCAL = 10_000
#: So many names are compared as constants, which scans can skip by; more are joined.
MAX_CONSTANTS = 200
#: Up to so many saved names are broadcast to the edges.
MAX_BROADCAST = 200_000


class Names:
    """Different names (column name) at one distance."""

    def __init__(self, spark: SparkSession, dist: int, found: DataFrame, seen: list[Names] = ()):
        """The names found, without those that were seen before."""
        self.dist = dist
        found = found.where("name IS NOT NULL").distinct()
        self.local: list[str] | None = None
        if all(x.local is not None for x in seen):
            known = {n for x in seen for n in x.local}
            got = [r.name for r in found.limit(MAX_LOCAL + len(known) + 1).collect()]
            fresh = sorted({*got} - known)
            if len(got) <= MAX_LOCAL + len(known) and len(fresh) <= MAX_LOCAL:
                self.local = fresh
        if self.local is None:
            for x in seen:
                found = found.join(x.df, "name", "left_anti")
            self.df = saved(found)
            self.n = self.df.count()
        else:
            self.df = spark.createDataFrame([(n,) for n in self.local], "name string")
            self.n = len(self.local)

    def among(self, rows: DataFrame, column: str) -> DataFrame:
        """rows whose column is one of the names."""
        if self.local is not None and self.n <= MAX_CONSTANTS:
            return rows.where(F.col(column).isin(self.local))
        return rows.join(self.hinted(column), column, "left_semi")

    def hinted(self, column: str) -> DataFrame:
        names = self.df.select(F.col("name").alias(column))
        return F.broadcast(names) if self.n <= MAX_BROADCAST else names


class Scan:
    """Edges read from a table (subject, object, ...). canonical: names are compared by their canonical keys."""

    def __init__(self, edges: DataFrame, canonical: bool = False):
        self.columns = edges.columns
        key = canonical_key if canonical else F.col
        self.edges = edges.withColumn("_s", key("subject")).withColumn("_o", key("object"))

    def ends(self, names: Names) -> DataFrame:
        """The ends (name) of edges that touch the names."""
        if names.local is not None and names.n <= MAX_CONSTANTS:
            hit = self.edges.where(F.col("_s").isin(names.local) | F.col("_o").isin(names.local))
        else:
            hit = self.reached([names])
        return hit.select(F.explode(F.array("_s", "_o")).alias("name"))

    def reached(self, names: list[Names]) -> DataFrame:
        """Edges with `dist`, a row for each different distance of an edge's ends. One pass over the edges, whatever the hops."""
        spark = self.edges.sparkSession
        if all(x.local is not None for x in names):
            rows = spark.createDataFrame([(n, x.dist) for x in names for n in x.local], "name string, dist int")
        else:
            rows = None
            for x in names:
                own = x.df.withColumn("dist", F.lit(x.dist))
                rows = own if rows is None else rows.unionByName(own)
        small = sum(x.n for x in names) <= MAX_BROADCAST
        out = self.edges
        for c in ("_s", "_o"):
            side = rows.select(F.col("name").alias(c), F.col("dist").alias(f"{c}_dist"))
            out = out.join(F.broadcast(side) if small else side, c, "left")
        dists = F.array_distinct(F.array_compact(F.array("_s_dist", "_o_dist")))
        return out.withColumn("dist", F.explode(dists)).select(*self.columns, "_s", "_o", "dist")


class Adjacency:
    """Edges read from a stored adjacency: rows are as from both_directions, kept by folders of `bucket`."""

    def __init__(self, rows: DataFrame, columns: list[str], canonical: bool = False):
        self.rows, self.columns, self.canonical = rows, columns, canonical

    def where(self, condition: Column) -> Adjacency:
        return Adjacency(self.rows.where(condition), self.columns, self.canonical)

    def by(self, canonical: bool) -> Adjacency:
        return Adjacency(self.rows, self.columns, canonical)

    def touched(self, names: Names) -> DataFrame:
        """Rows of the names, from their folders only."""
        key = F.col("name") if self.canonical else canonical_key("name")
        folders = [r.bucket for r in names.df.select(bucket_of(key).alias("bucket")).distinct().collect()]
        return names.among(self.rows.where(F.col("bucket").isin(folders)), "key" if self.canonical else "end")

    def ends(self, names: Names) -> DataFrame:
        key = canonical_key if self.canonical else F.col
        return self.touched(names).select(F.explode(F.array(key("subject"), key("object"))).alias("name"))

    def reached(self, names: list[Names]) -> DataFrame:
        out = None
        for x in names:
            own = self.touched(x).withColumn("dist", F.lit(x.dist)).dropDuplicates(["edge_id"])
            out = own if out is None else out.unionByName(own)
        return out.select(*self.columns, "dist")


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def both_directions(edges: DataFrame, edge_id: Column | None = None) -> DataFrame:
    """edges under each of their ends (a loop once), with end, key (its canonical key), bucket and edge_id, by which an edge's rows
    are known as one."""
    rows = edges.withColumn("edge_id", F.monotonically_increasing_id() if edge_id is None else edge_id)
    rows = rows.withColumn("end", F.explode(F.array_distinct(F.array("subject", "object")))).withColumn("key", canonical_key("end"))
    return rows.withColumn("bucket", bucket_of(F.col("key")))


def write_adjacency(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows from both_directions as Parquet, in folders by bucket. Dealt by ranges of (bucket, key, edge), so a hub's rows go to
    several files and others' files hold few keys."""
    order = ["bucket", "key", "edge_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(path)


def store_adjacency(edges: DataFrame) -> Adjacency:
    """An adjacency of edges, written to the shared folder."""
    folder = new_folder(edges.sparkSession)
    rows = both_directions(edges)
    write_adjacency(rows, folder)
    return Adjacency(edges.sparkSession.read.schema(rows.schema).parquet(folder), edges.columns)


def reach(source: Scan | Adjacency, start: DataFrame, hops: int) -> list[Names]:
    """The names at distances 0 (column name of start) to hops - 1."""
    spark = start.sparkSession
    out = [Names(spark, 0, start)]
    for dist in range(1, hops):
        found = Names(spark, dist, source.ends(out[-1]), out)
        if not found.n:
            break
        out.append(found)
    return out
