"""Near-duplicate classes by Order MinHash, candidates verified by banded alignment.

A text's words are its white-space-separated parts in lower case. Two texts are linked if aligning their words within the
band of diagonals that the threshold allows takes at most (1 - SIMILARITY) * (words of the longer text) insertions,
deletions and replacements. Classes are the links' connected components; a class is named by its smallest id.

1. Equal texts become one node (by 128-bit hash), so copies are never compared.
2. A node's k-word shingles are labelled with their occurrence number. For each of a tier's random orders the two smallest
   labelled shingles are taken and kept in text order; their hash is a signature, so texts meet in a bucket if they agree on
   both shingles and on which comes first. Five-word shingles (FIVE orders) bring together what shares 0.8 of its shingles.
   Words changed here and there break more five-word shingles than 0.8 of the words would let expect, so texts of over
   MIDDLE words also have LONG orders of three-word shingles, those of over SHORT words MEDIUM orders of two-word shingles,
   and shorter ones all pairs of their two-word shingles (see `Sketcher.tiers`).
3. Each bucket names a leader (its smallest node, a plain aggregate); each node is compared with the one leader that it
   meets most often. That settles groups of any size at one comparison a node.
4. What is left are buckets that hold nodes of different classes. There all nodes of different classes are compared, by
   sketches only, in blocks of BLOCK nodes. First, of the pairs that pass, those that best connect the classes (a spanning
   forest) are aligned. Then, with what is connected by them, all pairs of different classes that pass are. There may be
   many, since texts that nearly reach the threshold may be many: the nodes are dealt into blocks by their leaders, and
   each two blocks' texts meet once in a task that aligns their pairs and returns links only. So no link between nodes that
   share a bucket depends on a leader, and no pair within a class is made.
5. A sketch has one byte for each of SKETCH random orders, that of the order's smallest labelled word. Of texts at the
   threshold two thirds of the words or more are common (labelled, by Jaccard), so 43 of 64 bytes agree on average; pairs
   that agree on fewer than AGREE, 4.4 standard deviations less, aren't aligned.

The cost of 4 grows with the square of a bucket's nodes of different classes, that is of different texts that share both
smallest shingles of an order, at some 20 ns a pair and without a text being moved.

Edge cases: a null text is in no class but its own (class_id is the row's id); texts without words are equal only to
equal texts; rows with the same text, repeated rows among them, share a class; a class whose ids are all null has a null
class_id; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import Scratch, slices, table

SIMILARITY = 0.8
#: Words of a shingle, and the random orders of five-word shingles.
SHINGLE, FIVE = 5, 12
#: Up to SHORT words a text gives all pairs of two-word shingles, up to MIDDLE words MEDIUM orders of two-word shingles, and
#: beyond LONG orders of three-word shingles.
SHORT, MIDDLE, MEDIUM, LONG = 12, 32, 48, 96
#: Bytes of a sketch, and how many have to agree.
SKETCH, AGREE = 64, 26
#: Nodes of a bucket that are compared with each other at once; members of a leader that read its text in one task; nodes
#: of a leader whose texts are aligned with another block's at once.
BLOCK, TOGETHER, TEXTS = 2048, 512, 256
#: Up to so many nodes that need their texts compared are broadcast to pick those texts; beyond, they are joined.
MAX_BROADCAST_NODES = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles with their occurrence numbers, in text order; a shorter text is one shingle. h: the words' hashes."""
    n, size = max(1, len(h) - k + 1), min(k, len(h))
    places = _mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    x = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        x += h[i : i + n] * places[i]
    x = _mixed(x)
    ranked = np.sort(x)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(again):
        at = np.flatnonzero(np.isin(x, again))
        at = at[np.argsort(x[at], kind="stable")]
        own = x[at]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        turn = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        x[at] = np.where(turn > 0, _mixed(own + turn.astype(np.uint64) * _ODD), own)
    return x


class Orders:
    """Random orders of 64-bit hashes."""

    def __init__(self, count: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.count = count
        self.flip = rng.integers(0, 1 << 32, count, np.uint32)[:, None]
        self.by = (rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1))[:, None]
        self.label = _mixed(np.arange(count, dtype=np.uint64) + np.uint64(seed << 20))

    def _ranked(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each hash's place in some of the orders at a time."""
        short, step = (x >> np.uint64(32)).astype(np.uint32), max(1, (1 << 18) // len(x))
        for low in range(0, self.count, step):
            y = (short[None, :] ^ self.flip[low : low + step]) * self.by[low : low + step]
            yield y ^ (y >> np.uint32(15))

    def pairs(self, x: np.ndarray) -> np.ndarray:
        """Per order a hash of its two smallest, in the order in which they stand in x."""
        at = []
        for y in self._ranked(x):
            rows = np.arange(len(y))
            a = y.argmin(axis=1)
            y[rows, a] = _TOP
            at.append((a, y.argmin(axis=1) if len(x) > 1 else a))
        a, b = (np.concatenate(v) for v in zip(*at, strict=True))
        return _mixed(_mixed(x[np.minimum(a, b)] + self.label) + x[np.maximum(a, b)])

    def bytes(self, x: np.ndarray) -> bytes:
        """Per order a byte of its smallest."""
        least = np.concatenate([y.min(axis=1) for y in self._ranked(x)])
        return (_mixed(least + self.label) & np.uint64(255)).astype(np.uint8).tobytes()


class Sketcher:
    """Order MinHash signatures and sketches of texts."""

    def __init__(self, least: float = SIMILARITY):
        self.least = least
        self.five, self.medium, self.long, self.word = Orders(FIVE, 5), Orders(MEDIUM, 2), Orders(LONG, 3), Orders(SKETCH, 1)
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def tiers(self, n: int) -> range:
        """The tiers (0: all pairs, 1: MEDIUM, 2: LONG) of a text of n words: its own, and those of shorter similar texts."""
        of = lambda m: (m > SHORT) + (m > MIDDLE)
        return range(of(int(np.ceil(self.least * n - 1e-9))), of(n) + 1)

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Distinct signatures, as signed numbers."""
        tiers, parts = self.tiers(len(h)), []
        if len(h) >= SHINGLE:
            parts.append(self.five.pairs(labelled(h, SHINGLE)))
        if tiers[0] < 2:
            two = labelled(h, 2)
            if 0 in tiers:
                a, b = np.triu_indices(len(two), 1) if len(two) > 1 else (np.zeros(1, np.int64),) * 2
                parts.append(_mixed(_mixed(two[a] + _ODD) + two[b]))
            if 1 in tiers:
                parts.append(self.medium.pairs(two))
        if 2 in tiers:
            parts.append(self.long.pairs(labelled(h, 3)))
        return np.unique(np.concatenate(parts)).view(np.int64)

    def sketch(self, h: np.ndarray) -> bytes:
        return self.word.bytes(labelled(h, 1))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _places(a: list[str]) -> dict[str, int]:
    """Per word the places where it stands in a, as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(a):
        out[w] = out.get(w, 0) | 1 << i
    return out


def within(a: list[str], b: list[str], most: int) -> int | None:
    """The least number of insertions, deletions and replacements of words that make a into b, or None if over `most`.

    A band of the diagonals up to `most` off is followed, a column of it at a time as bits of two numbers: where the
    distance grows (up) and where it falls (down) from one place of a to the next.
    """
    if abs(len(a) - len(b)) > most or max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    end_a, end_b = len(a), len(b)
    while end_a > low and end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[low:end_a], b[low:end_b]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    # The band's lowest diagonal starts at place `deep` of a and ends at its last place; from there on the last row is followed.
    deep = min(most, n)
    width = deep + most + 1
    every, top = (1 << width) - 1, width - 1
    up, down, edits = every ^ ((1 << (width - deep - 1)) - 1), 0, deep
    shift, places = deep + 1 - width, _places(a)
    for j, w in enumerate(b):
        at = places.get(w, 0)
        x = (at >> shift if shift >= 0 else at << -shift) & every
        same = (((x & up) + up) ^ up | x | down) & every
        rise = down | every & ~(same | up)
        fall = same & up
        if j < n - deep:
            edits += not same >> top & 1
        else:
            row = top - 1 - (j - (n - deep))
            edits += (rise >> row & 1) - (fall >> row & 1) if row >= 0 else 0
        # What is left to do can't lower it by more than the columns beyond the diagonal's end.
        if edits > most + m - max(j + 1, n - deep):
            return None
        up = (fall | ~(same >> 1 | rise)) & every
        down = same >> 1 & rise
        shift += 1
    return edits if edits <= most else None


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = words_of(a), words_of(b)
    longer = max(len(x), len(y))
    return within(x, y, int((1 - least) * longer + 1e-9)) is not None


def node(text: Column) -> Column:
    """The node of a text: null for null."""
    return F.unhex(F.md5(text))


def _sketches(docs: DataFrame, text_col: str, least: float) -> DataFrame:
    """Per different text with words: node, id (64 bits of it), n (words), sketch, sigs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, seen = Sketcher(least), set()
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                key = md5(text.encode()).digest()
                if key in seen or not (words := words_of(text)):
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                h = sketcher.hashes(words)
                rows.append((key, len(h), sketcher.sketch(h), sketcher.signatures(h)))
            for at in range(0, len(rows), 1000):
                some = list(zip(*rows[at : at + 1000], strict=True))
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(some, kinds, strict=True)], names=["node", "n", "sketch", "sigs"])

    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    # A task yields a text once as far as its memory goes; other repeats meet here, one row a task.
    found = texts.mapInArrow(sketch, "node binary, n int, sketch binary, sigs array<bigint>")
    once = found.groupBy("node").agg(F.first(F.struct("n", "sketch", "sigs")).alias("x"))
    return once.select("node", F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("id"), "x.*")


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, n, n2, sketch, sketch2) whose lengths and sketches let them be similar: a, b."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "sketch2"))
                ok = (one == two).sum(axis=1, dtype=np.uint8) >= AGREE
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    longer, shorter = F.greatest("n", "n2"), F.least("n", "n2")
    fit = pairs.where(longer - shorter <= F.floor((1 - least) * longer + 1e-9))
    return fit.select("a", "b", "sketch", "sketch2").mapInArrow(keep, "a binary, b binary")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, least: float, work: Scratch) -> DataFrame:
    """The pairs of nodes (a, b) that are links. A text that many pairs hold as b goes to a task for each TOGETHER of them."""
    wanted = work.save("wanted", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "node"))
    rows = docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    some = rows.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_NODES else wanted, "node", "left_semi")
    texts = work.save("texts", some.dropDuplicates(["node"]))
    most = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / TOGETHER).cast("int").alias("salts"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("other")).join(most, "b")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    left = pairs.join(most, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int")).drop("salts")
    left = left.join(texts.withColumnRenamed("node", "a"), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ok = [similar(a, b, least) for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return left.join(right, ["b", "salt"]).select("a", "b", "text", "other").mapInArrow(verify, "a binary, b binary")


def components(links: DataFrame, work: Scratch | None = None) -> DataFrame:
    """Connected components of links (a, b): each node (n) with the component's least node (label)."""
    work = work or Scratch(links.sparkSession)
    both = links.select(F.col("a").alias("n"), F.col("b").alias("m"))
    edges = work.save("edges", both.unionByName(both.select(F.col("m").alias("n"), F.col("n").alias("m"))).where("n != m").distinct())
    labels = work.save("labels", edges.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("n").alias("m"), "label"), "m").groupBy("n").agg(F.min("label").alias("near"))
        step = work.save("step", labels.join(near, "n").select("n", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # Half the way to a distant root at once: take the label of the label.
        far = step.join(step.select(F.col("n").alias("label"), F.col("label").alias("far")), "label", "left")
        moved = work.save("labels", far.select("n", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = moved.select("n", "label")
        if moved.where("label != old").isEmpty():
            work.drop("edges", "step")
            return labels


def _forest(a: np.ndarray, b: np.ndarray, likeness: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Of pairs of places (a, b) those that connect their classes (lab) with the greatest likeness."""
    root = {c: c for c in lab.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    kept = []
    for i in np.argsort(-likeness, kind="stable").tolist():
        x, y = find(int(lab[a[i]])), find(int(lab[b[i]]))
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def _met(members: DataFrame, nodes: DataFrame, forest: bool, least: float, work: Scratch, block: int) -> DataFrame:
    """Pairs of different classes that share a bucket and whose sketches agree: with `forest` those that connect each bucket's
    classes best (x, y), else all, as lists by their homes (hx, hy, pairs; a pair may come again). members: sig, id; nodes: id, home, n, sketch, lab."""
    classes = members.join(nodes.select("id", "lab"), "id")
    split = classes.groupBy("sig").agg(F.count("*").alias("c"), F.min("lab").alias("low"), F.max("lab").alias("high")).where("low != high")
    split = split.select("sig", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    # Each two blocks of a bucket meet in one cell: x below y, or a block with itself. A bucket gets its blocks before its nodes join.
    split = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = members.join(split, "sig").join(nodes.select("id", "home", "lab", "n", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.select("sig", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "id", "home", "lab", "n", "sketch")
    cells = rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def pairs_of(cell: pa.Table) -> np.ndarray:
        own, ids, home, lab, n = (cell.column(c).to_numpy() for c in ("own", "id", "home", "lab", "n"))
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        across = cell.column("x")[0].as_py() != cell.column("y")[0].as_py()
        left, right, likeness = [], [], []
        for i in range(len(ids)):
            rest = slice(i + 1, None)
            top = np.maximum(n[rest], n[i])
            ok = (lab[rest] != lab[i]) & (top - np.minimum(n[rest], n[i]) <= np.floor((1 - least) * top + 1e-9))
            if across:
                ok &= own[rest] != own[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                agree = (sketch[at] == sketch[i]).sum(axis=1, dtype=np.uint8)
                near = agree >= AGREE
                left.append(np.full(int(near.sum()), i))
                right.append(at[near])
                likeness.append(agree[near])
        none = [np.zeros(0, np.int64)]
        a, b, agree = (np.concatenate(v or none) for v in (left, right, likeness))
        if forest and len(a) > 1:
            kept = _forest(a, b, agree.astype(np.int64), lab)
            a, b = a[kept], b[kept]
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        return np.stack([ids[a], ids[b], home[a], home[b]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come in order, so one is held at a time."""
        held: list[pa.RecordBatch] = []

        def cut(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            keys = [rows.column(c).to_numpy() for c in ("sig", "x", "y")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            ends = [0, *ends.tolist(), *[len(keys[0])] * last]
            found = [pairs_of(rows.slice(s, e - s)) for s, e in zip(ends, ends[1:], strict=False)]
            x, y, hx, hy = np.unique(np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1), axis=1)
            if forest:
                for at in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000]) for v in (x, y)], names=["x", "y"])
            elif len(x):
                by = np.lexsort((hy, hx))
                x, y, hx, hy = x[by], y[by], hx[by], hy[by]
                starts = np.flatnonzero(np.concatenate(([True], (hx[1:] != hx[:-1]) | (hy[1:] != hy[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
                yield pa.RecordBatch.from_arrays([pa.array(hx[starts]), pa.array(hy[starts]), lists], names=["hx", "hy", "pairs"])
            held[:] = rows.slice(ends[-1]).combine_chunks().to_batches() if not last else []

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 100_000:
                yield from cut(pa.Table.from_batches(held), False)
                rows = 0
        if held:
            yield from cut(pa.Table.from_batches(held), True)

    if forest:
        return cells.mapInArrow(compare, "x bigint, y bigint").distinct()
    return cells.mapInArrow(compare, "hx bigint, hy bigint, pairs array<struct<x:bigint,y:bigint>>")


def _ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of ids (x, y) as pairs of nodes (a, b): all that have these ids, if 64 bits should not tell two nodes apart."""
    ends = nodes.select("id", "node")
    both = pairs.join(ends.select(F.col("id").alias("x"), F.col("node").alias("a")), "x")
    return both.join(ends.select(F.col("id").alias("y"), F.col("node").alias("b")), "y").select("a", "b")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hx, hy, pairs) in the order of hx and hy one for each two blocks, with each pair once. What is held are the
    different pairs of one cell, about TEXTS * TEXTS at most, and the next row's, however many buckets a pair has met in."""
    names = ["hx", "hy", "pairs"]
    cell: tuple[int, int] | None = None
    held = np.zeros((2, 0), np.int64)

    def row() -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["x", "y"])
        lists = pa.ListArray.from_arrays(pa.array([0, held.shape[1]], pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int64()), pa.array([cell[1]], pa.int64()), lists], names=names)

    for batch in batches:
        for hx, hy, pairs in zip(*(batch.column(c) for c in names), strict=True):
            key, new = (hx.as_py(), hy.as_py()), np.stack([pairs.values.field(k).to_numpy() for k in (0, 1)])
            if key != cell:
                if cell is not None:
                    yield row()
                cell, held = key, held[:, :0]
            held = np.unique(np.concatenate([held, new], axis=1), axis=1)
    if cell is not None:
        yield row()


def _aligned(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, least: float, work: Scratch) -> DataFrame:
    """The pairs (hx, hy, pairs) that are links (a, b), aligned in blocks of nodes: a text goes once to each two blocks that hold
    pairs of it."""
    kind = "hx bigint, hy bigint, pairs array<struct<x:bigint,y:bigint>>"
    cells = work.save("cells", pairs.repartition("hx", "hy").sortWithinPartitions("hx", "hy").mapInArrow(_united, kind))
    ids = F.array_distinct(F.concat(F.transform("pairs", lambda p: p["x"]), F.transform("pairs", lambda p: p["y"])))
    held = cells.select("hx", "hy", F.explode(ids).alias("id")).join(nodes.select("id", "node"), "id")
    wanted = work.save("wanted", held.select("node").distinct())
    rows = docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    some = rows.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_NODES else wanted, "node", "left_semi")
    texts = work.save("texts", some.dropDuplicates(["node"]))
    some = held.join(texts, "node").select("hx", "hy", F.lit(None).cast("array<struct<x:bigint,y:bigint>>").alias("pairs"), "id", "node", "text")
    both = some.unionByName(cells.select("hx", "hy", "pairs", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("string").alias("text")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come in order, each with its texts first and then its pairs."""
        cell, own = None, {}
        for batch in slices(batches, "text"):
            links = []
            for r in batch.to_pylist():
                if (r["hx"], r["hy"]) != cell:
                    cell, own = (r["hx"], r["hy"]), {}
                if r["pairs"] is None:
                    own.setdefault(r["id"], []).append((r["node"], words_of(r["text"])))
                    continue
                for x, y in ((p["x"], p["y"]) for p in r["pairs"]):
                    links += [(a, b) for a, v in own[x] for b, w in own[y] if within(v, w, int((1 - least) * max(len(v), len(w)) + 1e-9)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = both.repartition("hx", "hy").sortWithinPartitions("hx", "hy", F.col("pairs").isNotNull())
    return dealt.mapInArrow(align, "a binary, b binary")


def find_links(docs: DataFrame, work: Scratch, *, text_col: str = "text", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified links between different texts as nodes (a, b): enough to connect each class."""
    nodes = work.save("nodes", _sketches(docs, text_col, least))
    signed = nodes.select("id", F.explode("sigs").alias("sig"))
    # Saved on its own, so that its shuffle is gone before the join's.
    lead = signed.groupBy("sig").agg(F.count("*").alias("c"), F.min("id").alias("leader")).where("c > 1").select("sig", "leader")
    members = work.save("members", signed.join(work.save("lead", lead), "sig"))
    work.drop("lead")
    # Each node with the one leader that it meets most often.
    often = members.where("id != leader").groupBy("id", "leader").agg(F.count("*").alias("c"))
    first = work.save("first", often.groupBy("id").agg(F.max(F.struct("c", "leader")).alias("best")).select("id", F.col("best.leader").alias("leader")))
    ends = nodes.select("id", "node", "n", "sketch")
    other = ends.select(*[F.col(c).alias(d) for c, d in (("id", "leader"), ("node", "b"), ("n", "n2"), ("sketch", "sketch2"))])
    led = first.join(ends.withColumnRenamed("node", "a"), "id").join(other, "leader").where("a != b")
    pairs = work.save("pairs", _near(led, least))
    links = work.save("led", _verified(pairs, docs, text_col, least, work))
    # A node's home: its leader, and a block of that leader's nodes.
    size = first.groupBy("leader").agg(F.ceil(F.count("*") / TEXTS).alias("blocks"))
    homes = first.join(size, "leader").select("id", F.xxhash64("leader", F.pmod(F.xxhash64("id"), "blocks")).alias("home"))
    plain = work.save("plain", nodes.drop("sigs").join(homes, "id", "left").withColumn("home", F.coalesce("home", F.xxhash64("id"))))
    work.drop("nodes", "first")
    for name in ("forest", "rest"):
        labels = components(links, work).withColumnRenamed("n", "node")
        classed = plain.join(labels, "node", "left").withColumn("lab", F.xxhash64(F.coalesce("label", "node"))).drop("label")
        classed = work.save("classed", classed)
        found = work.save("found", _met(members.select("sig", "id"), classed, name == "forest", least, work, block))
        if found.isEmpty():
            break
        if name == "forest":
            more = _verified(work.save("pairs", _ends(found, plain)), docs, text_col, least, work)
        else:
            more = _aligned(found, plain, docs, text_col, least, work)
        links = links.unionByName(work.save(name, more))
    work.drop("plain", "members", "classed", "pairs", "found", "texts", "wanted", "cells")
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Per node: its smallest id (own), its class's smallest id (class_id), and whether the class's document is one of the
    node's (first)."""
    work = Scratch(docs.sparkSession)
    labels = components(find_links(docs, work, text_col=text_col, **options), work)
    nodes = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("own"))
    nodes = work.save("own", nodes)
    linked = labels.withColumnRenamed("n", "node").join(nodes, "node")
    # A class's document: the smallest id, then the smallest node; nodes without an id come last.
    best = linked.groupBy("label").agg(F.min(F.struct(F.col("own").isNull().alias("no"), "own", "node")).alias("best"))
    named = linked.join(best, "label").select("node", F.col("best.own").alias("class_id"), (F.col("best.node") == F.col("node")).alias("first"))
    named = nodes.join(named, "node", "left")
    named = named.select("node", "own", F.when(F.col("first").isNull(), F.col("own")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))
    out = work.save("classes", named)
    work.drop("own", "labels", "led", "forest", "rest")
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id_col, class_id."""
    classes = _classes(docs, id_col, text_col, **options).select("node", "class_id")
    rows = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"))
    return rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one with the smallest id; of rows with equal ids and texts the one that is first
    as JSON. Rows with null texts all stay."""
    classes = _classes(docs, id_col, text_col, **options).where("first").select("node", "own")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"))
    count = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node")).groupBy("id", "node").agg(F.count("*").alias("n"))
    again = not count.where("n > 1 AND node IS NOT NULL").isEmpty()
    kept = rows.join(classes, "node").where("own <=> id")
    kept = kept.groupBy("node").agg(F.min_by("row", F.to_json("row")).alias("row")) if again else kept
    return kept.select("row.*").unionByName(rows.where("node IS NULL").select("row.*"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op2_near_dedup": op2_near_dedup}, {}
