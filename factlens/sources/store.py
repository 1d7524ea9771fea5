"""Tables of chunks, edges and entity mentions as Parquet folders, one folder a batch, and the documents' states.

A writer reserves a number by making a file that nobody else made, writes its batch's folders and commits them by one more
manifest, again a file that nobody else made: the list of the batches that count, and of streams the last micro-batch. So two writers never share a folder, a batch
that breaks off leaves no trace, and a reader keeps the files of the manifest that it read, whatever is committed afterwards.
Folders that no manifest lists any more are removed by `vacuum`, once nobody can be reading them.

A document's rows are those of the batch that holds its state with the highest version (the number of the batch that wrote it), so
a new version replaces the old one even if it has no rows, and a deleted document is one more state. A batch costs what it holds;
readers join the states; compact() rewrites what counts as one batch, versions included.

Edges are kept in the order of their validity (open ends apart), so that scans of a window skip row groups and pages by their
statistics, and under both ends in an adjacency, so that a hop reads few folders. What documents add to nodes and statistics
is kept by document, so both are merged from there and an edge is not read again.
"""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.operators.graph import graphml_lines, merge_parts, merge_stats, node_parts, stat_parts
from factlens.operators.traversal import Adjacency, both_directions, write_adjacency

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


CHUNKS = _schema("chunk_id string, doc_id string, doc_name string, text string, page int, start date, end date, start_label string, end_label string, entities strings, vector floats")
EDGES = _schema("subject string, predicate string, object string, valid_from date, valid_until date, start_label string, end_label string, doc_id string, chunk_id string, evidence string, confidence double, edge_seq long")
MENTIONS = _schema("name string, type string, aliases strings, doc_id string, seq long")
STATES = _schema("doc_id string, status string, error string, chunk_count long, entity_count long, relation_count long, version long")
ADJACENCY = T.StructType([*EDGES.fields, *_schema("edge_id long, end string, key string, bucket int").fields])
STATS = _schema("doc_id string, predicate string, edges long, validated long, open_ended long, earliest date, latest date")
NODES = T.StructType([
    *_schema("name string, doc_id string").fields,
    T.StructField("type", _schema("generic int, seq long, type string")),
    T.StructField("aliases", _schema("end int, seq long, aliases strings")),
    T.StructField("n", T.LongType()),
])
TABLES = {"chunks": CHUNKS, "edges": EDGES, "adjacency": ADJACENCY, "mentions": MENTIONS, "nodes": NODES, "stats": STATS}
#: Bytes of a row group of edges, and rows of its pages, each with statistics of its own: smaller ones skip more.
ROW_GROUP, PAGE_ROWS = 32 << 20, 2000


def write_by_validity(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """edges as Parquet in the order of their validity, those without an end apart: files, row groups and pages cover short ranges of
    days. edge_seq is last in the order, so that many facts of one day go to several files."""
    order = [F.col("valid_until").isNull(), F.col("valid_from"), F.col("valid_until"), F.col("edge_seq")]
    edges.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


class Store:
    """A folder with the tables. Writers need a file system that creates a file exclusively (overwrite=False)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        folder, files = self._folder(name)
        return [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []

    def _put_new(self, name: str, text: str) -> bool:
        """Whether a file was made with this text; False if there was one."""
        file, files = self._folder(name)
        try:
            out = files.create(file, False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or files.exists(file):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _manifest(self) -> tuple[int, dict]:
        """The newest manifest's number, and what it says: `batches` that count with the tables each has, and `sources`, the streams'
        last micro-batches."""
        for _ in range(100):
            number = max([int(x.partition(".")[0]) for x in self._names("manifest") if x.endswith(".json")], default=0)
            if not number:
                return 0, {"batches": {}, "sources": {}}
            file, files = self._folder(f"manifest/{number:012d}.json")
            stream = files.open(file)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):  # else its writer hasn't finished
                return number, json.loads(text)
            time.sleep(0.05)
        raise RuntimeError(f"manifest {number} of {self.path} isn't whole")

    def _batches(self) -> dict[str, list[str]]:
        return self._manifest()[1]["batches"]

    def has(self, source: str, number: int) -> bool:
        """Whether a stream's micro-batch was committed."""
        return self._manifest()[1]["sources"].get(source, -1) >= number

    def reserve(self) -> int:
        """A batch number that no other writer has."""
        n = max([int(x) for x in self._names("reserved") if x.isdigit()], default=0) + 1
        while not self._put_new(f"reserved/{n:012d}", ""):
            n += 1
        return n

    def commit(self, batch: int, tables: list[str], instead_of: list[str] = (), source: tuple[str, int] | None = None) -> bool:
        """The batch counts from now on, in place of others. Writers that commit at the same time do so one after the other. False,
        and no change, if the batch is of a stream's micro-batch (source) that was committed already."""
        while True:
            number, said = self._manifest()
            live, sources = said["batches"], said["sources"]
            if missing := [x for x in instead_of if x not in live]:
                raise RuntimeError(f"batches {missing} were replaced by another writer")
            if source:
                if sources.get(source[0], -1) >= source[1]:
                    return False
                sources = sources | {source[0]: source[1]}
            now = {k: v for k, v in live.items() if k not in instead_of} | {str(batch): tables}
            if self._put_new(f"manifest/{number + 1:012d}.json", json.dumps({"batches": now, "sources": sources}) + "\n"):
                return True

    def _read(self, name: str, schema: T.StructType, live: dict[str, list[str]]) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        paths = [f"{self.path}/{name}/batch={k}" for k, tables in live.items() if name in tables]
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _states(self, live: dict[str, list[str]]) -> DataFrame:
        rows = self._read("states", STATES, live)
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "version").alias("s")).select("doc_id", "s.*")

    def states(self) -> DataFrame:
        """The last state of each document, with the batch that holds it."""
        return self._states(self._batches())

    def _live(self, name: str, batches: dict[str, list[str]] | None = None) -> DataFrame:
        batches = self._batches() if batches is None else batches
        live = self._states(batches).where("status = 'indexed'").select("doc_id", "batch")
        return self._read(name, TABLES[name], batches).join(live, ["doc_id", "batch"], "left_semi").select(*TABLES[name].names)

    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def edges(self) -> DataFrame:
        return self._live("edges")

    def adjacency(self) -> Adjacency:
        """The edges under both ends, for traversals."""
        return Adjacency(self._live("adjacency"), EDGES.names)

    def mentions(self) -> DataFrame:
        return self._live("mentions")

    def nodes(self) -> DataFrame:
        """Merged from what each live document says of its names."""
        return merge_parts(self._live("nodes"))

    def stats(self) -> DataFrame:
        """The graph's statistics, merged from the live documents' parts: replaced and deleted documents' no longer count."""
        return merge_stats(self._live("stats"), self.nodes())

    def put(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """rows written as a batch's part of a table, and read again. Vectors of another width raise ValueError."""
        schema = TABLES.get(name, STATES)
        rows = rows.select(*schema.names)
        old = [r.n for r in self.chunks().select(F.size("vector").alias("n")).limit(1).collect()] if name == "chunks" else []
        path = f"{self.path}/{name}/batch={batch}"
        if name == "edges":
            write_by_validity(rows, path, "overwrite")
        elif name == "adjacency":
            write_adjacency(rows, path, "overwrite")
        else:
            rows.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        if old and (found := {r.n for r in out.select(F.size("vector").alias("n")).distinct().limit(3).collect()} | set(old)) != set(old):
            raise ValueError(f"vectors of different widths: {sorted(found)}")
        return out

    def put_graph(self, edges: DataFrame, mentions: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """A batch's edges (with edge_seq) and mentions, with the adjacency and parts that follow from them."""
        edges, mentions = self.put("edges", edges, batch), self.put("mentions", mentions, batch)
        self.put("adjacency", both_directions(edges, F.col("edge_seq")), batch)
        self.put("nodes", node_parts(mentions, edges), batch)
        self.put("stats", stat_parts(edges), batch)
        return edges, mentions

    def delete_document(self, doc_id: str) -> None:
        batch = self.reserve()
        named = {"doc_id": F.lit(doc_id), "status": F.lit("deleted"), "version": F.lit(batch)}
        gone = self.spark.range(1).select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATES.fields])
        self.put("states", gone, batch)
        self.commit(batch, ["states"])

    def compact(self) -> None:
        """What counts of all batches as one batch. Readers of the old batches go on; `vacuum` removes those. If another compaction
        was faster, this one raises RuntimeError and changes nothing; batches that others commit meanwhile stay as they are."""
        live = self._batches()
        batch = self.reserve()
        for name in TABLES:
            self.put(name, self._live(name, live), batch)
        self.put("states", self._states(live), batch)
        self.commit(batch, [*TABLES, "states"], [*live])

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Remove the folders of batches that the newest manifest doesn't list, if their number was reserved and the newest manifest
        was made more than `older_than` seconds ago; returns how many. That has to be longer than any reader or writer takes."""
        number, live = self._manifest()[0], self._batches()
        if not number:
            return 0
        now = time.time()
        age = lambda name: now - (lambda f: f[1].getFileStatus(f[0]).getModificationTime())(self._folder(name)) / 1000
        if age(f"manifest/{number:012d}.json") < older_than:
            return 0
        gone = set()
        for name in (*TABLES, "states"):
            for x in self._names(name):
                k = x.removeprefix("batch=")
                if k != x and k not in live and age(f"reserved/{int(k):012d}") >= older_than:
                    folder, files = self._folder(f"{name}/{x}")
                    files.delete(folder, True)
                    gone.add(k)
        return len(gone)

    def count(self) -> int:
        return self.chunks().count()

    def doc_ids(self) -> DataFrame:
        return self.chunks().select("doc_id").distinct().orderBy("doc_id")


def write_json(edges: DataFrame, path: str, most: int = 100_000) -> None:
    """The first `most` edges as JSON lines."""
    edges.orderBy("edge_seq").limit(most).write.mode("overwrite").json(path)


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """The graph as one GraphML document over the text files of a folder, in the files' order."""
    frame = edges.sparkSession.createDataFrame(
        [(-1, '<?xml version="1.0" encoding="UTF-8"?>'), (-1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (-1, *["".join(f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for c, k in (("type", "node"), ("predicate", "edge"), ("valid_from", "edge"), ("valid_until", "edge"), ("doc_id", "edge"), ("chunk_id", "edge"))) + '<graph edgedefault="directed">']), (2, "</graph></graphml>")],
        "part int, value string",
    ).coalesce(1)
    rows = frame.withColumn("line", F.monotonically_increasing_id()).unionByName(graphml_lines(edges, nodes).withColumn("line", F.lit(0).cast("long")))
    rows.orderBy("part", "line").select("value").write.mode("overwrite").text(path)
