"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens end there how often.

A text is read as its bytes with a space before them. Tokenizer A (byte-level BPE, a tokenizers JSON file) encodes space + text,
tokenizer B (a sentencepiece model that adds the space itself) encodes the text. Neither adds special tokens, and special
tokens' strings inside texts are plain text.

1. `Pair.align` takes a whole Arrow batch at once: its texts are concatenated, each with its byte offset. A's and B's token ends
   are counted by byte once (bincount); where both have one the batch is cut. Prefix sums over the batch, read at the documents'
   offsets, give each document its tokens, groups and links.
2. A link is a pair of an A and a B token that end on the same byte. Per batch the links are packed by buckets of B ids: each
   id pair once, with the documents that hold it and how often.
3. A bucket's pairs are summed over the corpus, one bucket at a time; then the packed batches pass by the bucket's counts and
   each yields a few numbers a document, which meet the documents again by batch. So tokens never become rows, a pair in all
   texts is one entry a document, and what a task holds is bounded by a batch or by a bucket's share of the two vocabularies.

Edge cases: a null or empty text has no tokens, nor has one whose tokens' bytes differ from space + text under A or B (for
instance a text with U+2581 under a sentencepiece model): zeros and no groups. Texts are encoded whole, whatever their length.
Repeated rows are rows of their own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import Kept, Scratch, slices, table, texts

#: The public tokenizers that the query takes, on the driver; their contents are broadcast.
A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at once (a longer text alone).
BATCH = 4 << 20

# Fixed value: how byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then U+0100 and on."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
    others = [c for c in range(256) if c not in plain]
    return {**{chr(c): c for c in plain}, **{chr(256 + i): c for i, c in enumerate(others)}}


class Entries:
    """A vocabulary's byte strings in one array."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligned(NamedTuple):
    """A batch of texts. n_a, n_b, n_groups: by text; a, b: the texts' token ids in order; a_end, b_end: whether a token ends a
    group. Groups follow the texts' order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray


class Pair:
    """The two tokenizers."""

    def __init__(self, files: tuple[bytes, bytes]):
        a = json.loads(files[0])
        special = {x["id"] for x in a["added_tokens"] if x["special"]}
        letters = byte_alphabet()
        ranks = {bytes(map(letters.__getitem__, k)): v for k, v in a["model"]["vocab"].items() if v not in special}
        # The merges' order is that of the ids in such a file, so the ids are ranks too.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            own[v] = k
        self.a_entries = Entries(own)
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_entries = Entries([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        width = len(str(max(len(own), len(pieces)) - 1))
        ids = np.arange(max(len(own), len(pieces)))
        self.n_digits = np.char.str_len(ids.astype(f"S{width}")).astype(np.int64)
        self.digits = np.concatenate([ids.astype(f"S{width}").view(np.uint8).reshape(-1, width), np.zeros((len(ids), 1), np.uint8)], axis=1)

    def align(self, batch: list[str]) -> Aligned:
        size = np.array([len(x.encode()) + 1 if x else 0 for x in batch], np.int64)
        some = np.flatnonzero(size)
        own = [batch[i] for i in some.tolist()]
        a = [self.a.encode_to_numpy(" " + x, disallowed_special=()) for x in own]
        b = self.b.encode(own, num_threads=1) if own else []
        counts = []
        for found in (a, b):
            n = np.zeros(len(batch), np.int64)
            n[some] = [len(x) for x in found]
            counts.append(n)
        ids = [np.concatenate([np.zeros(0, np.int64), *a]).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(counts[1].sum()))]
        entries = (self.a_entries, self.b_entries)
        # A text keeps its tokens if their bytes are as many as its own, and then if they are the same.
        sums = [_by_text(e.sizes[i], n) for e, i, n in zip(entries, ids, counts, strict=True)]
        ids, counts = _only((sums[0] == size) & (sums[1] == size), ids, counts)
        size = np.where(counts[0] > 0, size, 0)
        whole = np.frombuffer("".join(" " + x for x, n in zip(batch, counts[0].tolist(), strict=True) if n).encode(), np.uint8)
        wrong = (entries[0].joined(ids[0]) != whole) | (entries[1].joined(ids[1]) != whole)
        if wrong.any():
            ids, counts = _only(_by_text(wrong, size) == 0, ids, counts)
        ends = [np.cumsum(e.sizes[i]) for e, i in zip(entries, ids, strict=True)]
        n_bytes = int(ends[0][-1]) + 1 if len(ends[0]) else 1
        held = [np.bincount(e, minlength=n_bytes) for e in ends]
        a_end, b_end = held[1][ends[0]] > 0, held[0][ends[1]] > 0
        return Aligned(*counts, _by_text(a_end, counts[0]), *ids, a_end, b_end)

    def written(self, x: Aligned) -> list[str]:
        """Per text the lowercase hex SHA-256 of its groups as `a1,a2|b1;a3|b2,b3`; '' for a text without tokens."""
        # Each token goes after the tokens of the groups before its own, A's before B's.
        a_cut, b_cut = np.flatnonzero(x.a_end), np.flatnonzero(x.b_end)
        n = len(x.a) + len(x.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        a_at = np.arange(len(x.a)) + np.append(0, b_cut + 1)[np.cumsum(x.a_end) - x.a_end]
        b_at = np.arange(len(x.b)) + (a_cut + 1)[np.cumsum(x.b_end) - x.b_end]
        ids[a_at], ids[b_at] = x.a, x.b
        mark[a_at[a_cut]], mark[b_at[b_cut]] = ord("|"), ord(";")
        long = self.n_digits[ids]
        flat = self.digits[ids][np.arange(self.digits.shape[1]) <= long[:, None]]
        ends = np.cumsum(long + 1)
        flat[ends - 1] = mark
        text = memoryview(flat)
        last = np.append(0, ends)[np.append(0, np.cumsum(x.n_a + x.n_b))].tolist()
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(last, last[1:], strict=False)]

    def lists(self, x: Aligned) -> pa.ListArray:
        """Per text its groups as structs of the ids a and b."""
        parts = []
        for ids, end in ((x.a, x.a_end), (x.b, x.b_end)):
            cuts = np.append(0, np.flatnonzero(end) + 1).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(x.n_groups)).astype(np.int32)), pa.StructArray.from_arrays(parts, names=["a", "b"]))


def _by_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of values over stretches of n each: differences of prefix sums."""
    sums = np.append(0, np.cumsum(values, dtype=np.int64))
    return np.diff(sums[np.append(0, np.cumsum(n))])


def _only(kept: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tokens of the texts that are kept; the others have none."""
    return [i[np.repeat(kept, n)] for i, n in zip(ids, counts, strict=True)], [np.where(kept, n, 0) for n in counts]


_PAIR = Kept()


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: the width of one, then all in that width."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


class Buckets:
    """B ids dealt into buckets. A pair's code sorts by bucket, then B id, then A id."""

    def __init__(self, pair: Pair, n: int):
        self.n_a, n_b = len(pair.a_entries.sizes), len(pair.b_entries.sizes)
        ids = np.arange(n_b, dtype=np.uint64)
        bucket = ((ids * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)) % np.uint64(n)
        self.order = np.lexsort((ids, bucket))
        self.rank = np.argsort(self.order)
        self.starts = np.searchsorted(bucket[self.order], np.arange(n + 1, dtype=np.uint64)) * self.n_a

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes % self.n_a, self.order[codes // self.n_a]


_BUCKETS = Kept()
#: A packed batch and bucket: codes of its pairs (differences), how many links and documents each has, and for each pair's
#: documents in turn their places in the batch (differences) and links.
_LINKS = ["pairs", "totals", "times", "docs", "n"]


def _links(x: Aligned, buckets: Buckets) -> Iterator[tuple[int, list[bytes]]]:
    """The links of a batch by bucket, packed (_LINKS)."""
    n = max(1, len(x.n_a))
    doc = np.repeat(np.arange(len(x.n_groups)), x.n_groups)
    keys = np.sort((buckets.rank[x.b[x.b_end]] * buckets.n_a + x.a[x.a_end]) * n + doc)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(first, len(keys)))
    codes, docs = keys[first] // n, keys[first] % n
    pair = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))
    totals = np.add.reduceat(times, pair[:-1]) if len(codes) else times
    step = np.diff(docs, prepend=0)
    step[pair[:-1]] = docs[pair[:-1]]
    ends = np.searchsorted(codes[pair[:-1]], buckets.starts)
    for k in np.flatnonzero(np.diff(ends)).tolist():
        s, e = ends[k], ends[k + 1]
        own = slice(pair[s], pair[e])
        yield k, [narrow(v) for v in (np.diff(codes[pair[s:e]], prepend=0), totals[s:e], np.diff(pair[s : e + 1]), step[own], times[own])]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once with the sum of its counts."""
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return found, out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, pairs, totals) in the order of buckets as one row for each bucket; one bucket's pairs are held."""
    bucket, codes, counts = None, [], []

    def row() -> pa.RecordBatch:
        found, n = _summed(codes, counts)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([narrow(v)], pa.binary()) for v in (np.diff(found, prepend=0), n)]], names=["bucket", "pairs", "totals"])

    for batch in batches:
        for k, pairs, totals in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pairs", "totals")), strict=True):
            if k != bucket:
                if codes:
                    yield row()
                bucket, codes, counts = k, [], []
            codes.append(np.cumsum(wide(pairs)))
            counts.append(wide(totals))
            if len(codes) > 1 and sum(map(len, codes[1:])) > max(len(codes[0]), 100_000):
                codes, counts = ([x] for x in _summed(codes, counts))
    if codes:
        yield row()


class Alignment:
    """The packed links and the aligned documents of a table, saved."""

    def __init__(self, docs: DataFrame, files: tuple[bytes, bytes], *, id_col: str = "doc_id", text_col: str = "text", groups: str = "lists"):
        if groups not in ("lists", "sha256"):
            raise ValueError("groups is 'lists' or 'sha256'")
        spark, self.id_col = docs.sparkSession, id_col
        self.work = Scratch(spark)
        self.sent = sent = spark.sparkContext.broadcast(files)
        self.parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, n_buckets = ("groups" if groups == "lists" else "groups_sha256"), self.parts
        kind = "array<struct<a:array<int>,b:array<int>>>" if groups == "lists" else "string"
        arrow = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])) if groups == "lists" else pa.string()
        names = ["id", "blk", "idx", "n_a", "n_b", "n_groups", self.name, "bucket", *_LINKS]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of documents, then those of their packed links, for each block of texts."""
            pair = _PAIR.get(sent.value, Pair)
            buckets = _BUCKETS.get(pair, Buckets, n_buckets)
            blk = TaskContext.get().partitionId() << 32
            for batch in batches:
                for part in slices(iter([batch]), "text", BATCH):
                    x = pair.align(texts(part))
                    n = part.num_rows
                    own = pair.lists(x) if groups == "lists" else pa.array(pair.written(x), pa.string())
                    cols = [part.column("id"), pa.array([blk] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), *[pa.array(v, pa.int64()) for v in x[:3]], own.cast(arrow), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 5]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    links = list(_links(x, buckets))
                    n = len(links)
                    cols = [pa.nulls(n, part.column("id").type), pa.array([blk] * n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, arrow), pa.array([k for k, _ in links], pa.int32()), *[pa.array([v[i] for _, v in links], pa.binary()) for i in range(5)]]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    blk += 1

        own = docs.schema[id_col].dataType.simpleString()
        schema = f"id {own}, blk long, idx int, n_a long, n_b long, n_groups long, {self.name} {kind}, bucket int, pairs binary, totals binary, times binary, docs binary, n binary"
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.rows = self.work.save("rows", rows.mapInArrow(encode, schema))
        lists = self.rows.where("bucket IS NOT NULL").select("bucket", "pairs", "totals")
        counts = lists.repartition(self.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_counts, "bucket int, pairs binary, totals binary")
        self.counts = self.work.save("counts", counts)

    def link_counts(self) -> DataFrame:
        """a, b, n: how many links of the whole table hold each pair of ids."""
        sent, n_buckets = self.sent, self.parts

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets = _BUCKETS.get(_PAIR.get(sent.value, Pair), Buckets, n_buckets)
            for batch in batches:
                for pairs, totals in zip(batch.column("pairs").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                    a, b = buckets.ids(np.cumsum(wide(pairs)))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(wide(totals))], names=["a", "b", "n"])

        return self.counts.mapInArrow(listed, "a int, b int, n long")

    def documents(self) -> DataFrame:
        """One row per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and its groups."""
        sent, n_buckets, group = self.sent, self.parts, self.name

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per packed batch and bucket its documents' places, best links and sums of counts. A bucket's counts come first."""
            buckets = _BUCKETS.get(_PAIR.get(sent.value, Pair), Buckets, n_buckets)
            codes = counts = best = np.zeros(0, np.int64)
            for batch in batches:
                out = []
                for blk, *packed in zip(*(batch.column(c).to_pylist() for c in ("blk", *_LINKS)), strict=True):
                    own = np.cumsum(wide(packed[0]))
                    if blk is None:
                        codes, counts = own, wide(packed[1])
                        _, first = np.unique(codes // buckets.n_a, return_index=True)
                        tops = np.maximum.reduceat(counts, first)
                        best = counts == np.repeat(tops, np.diff(np.append(first, len(codes))))
                        continue
                    at, times, n = np.searchsorted(codes, own), wide(packed[2]), wide(packed[4])
                    # Places are differences within each pair's stretch.
                    steps = np.cumsum(wide(packed[3]))
                    start = np.cumsum(times) - times
                    docs = steps - np.repeat(np.append(0, steps)[start], times)
                    idx, where = np.unique(docs, return_inverse=True)
                    sums, hits = np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
                    np.add.at(sums, where, n * np.repeat(counts[at], times))
                    np.add.at(hits, where, n * np.repeat(best[at], times))
                    out.append((blk, narrow(np.diff(idx, prepend=0)), narrow(hits), narrow(sums)))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["blk", "idx", "hits", "sums"])

        def finished(docs: pa.Table, found: pa.Table) -> pa.Table:
            """The documents of one block with what its buckets say."""
            idx = docs.column("idx").to_numpy()
            best, sums = np.zeros((2, int(idx.max()) + 1 if len(idx) else 0), np.int64)
            for i, hits, s in zip(*(found.column(c).to_pylist() for c in ("idx", "hits", "sums")), strict=True):
                at = np.cumsum(wide(i))
                best[at] += wide(hits)
                sums[at] += wide(s)
            cols = [docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")]
            return pa.table([*cols, pa.array(best[idx]), pa.array(sums[idx]), docs.column(group)], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", group])

        links = self.rows.where("bucket IS NOT NULL").select("blk", "bucket", *_LINKS)
        none = F.lit(None).cast("binary")
        counts = self.counts.select(F.lit(None).cast("long").alias("blk"), "bucket", "pairs", "totals", none.alias("times"), none.alias("docs"), none.alias("n"))
        dealt = links.unionByName(counts).repartition(self.parts, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("blk"))
        found = dealt.mapInArrow(judged, "blk long, idx binary, hits binary, sums binary")
        docs = self.rows.where("bucket IS NULL").select("blk", "id", "idx", "n_a", "n_b", "n_groups", group)
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        schema = f"id {kinds['id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {group} {kinds[group]}"
        out = docs.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(finished, schema)
        return out.withColumnRenamed("id", self.id_col)


def read_files(a: str = A_PATH, b: str = B_PATH) -> tuple[bytes, bytes]:
    out = []
    for path in (a, b):
        with open(path, "rb") as file:
            out.append(file.read())
    return out[0], out[1]


def align_tokens(docs: DataFrame, files: tuple[bytes, bytes] | None = None, **options) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of their B id in
    the table), count_sum (the links' counts in the table, summed), and groups (array of structs of the ids a and b) or, with
    groups="sha256", groups_sha256."""
    return Alignment(docs, files or read_files(), **options).documents()


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), groups="sha256")


QUERIES, ORACLES = {"op11_cross_tokenizer": op11_cross_tokenizer}, {}
