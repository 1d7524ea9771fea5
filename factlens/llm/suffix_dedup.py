"""Repeated-substring removal: each byte that lies in a LENGTH-byte string which starts anywhere else too goes.

Suffixes are sampled by a difference cover: the residues in COVER modulo V are chosen so that for any two places i and j
some shift below V takes both to sampled places. So if two LENGTH-byte strings are equal, a sampled suffix in each of
them starts with the same LENGTH - V + 1 bytes. Only suffixes' equality up to LENGTH bytes matters, not their order
beyond it, so suffixes are dealt into buckets and sorted there by the hash of their opening.

1. Cover: the sampled suffixes' openings are hashed. One bucket is sorted at a time; equal openings share a rank, and a
   rank held twice or more is a tie.
2. Ties: only places within V before a tied sample can start a repeated string. Those places' LENGTH-byte strings are
   hashed (64 bits) and again sorted bucket by bucket; ranks held twice or more are the repeated strings.

A string's bucket is that of its anchor, the GRAM-byte piece in it with the smallest hash: equal strings have equal anchors,
and neighbouring places mostly share theirs, so a text's places go to few buckets and come back in few rows.

Before anything is sent to a rank's bucket, a task keeps one place per rank and marks the others as repeated there and
then, where nothing is left to sort. So a passage in a third of all texts sends one place per task to its bucket. Buckets
have about BUCKET places, however much data there is; one that has more than twice as many, since many strings share an
anchor, is split by the strings' hashes. Equal texts are found
first by their hashes and take part once. What a step shuffles is freed before the next one shuffles.

Edge cases: a null text counts as empty; texts below LENGTH bytes lose nothing; equal texts of LENGTH bytes or more lose
everything; repeated rows are equal texts; extra columns are not read. Texts are
told apart by 96 bits of hashes (id, id2).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import Scratch, slices, table

LENGTH = 400
ORDER = 11  # a prime: the cover has ORDER + 1 residues modulo V
BUCKET = 400_000
#: Bytes of an anchor.
GRAM = 32
#: Places a task gathers before it sends them on, and bytes that are hashed at once.
GATHERED, SEGMENT = 600_000, 1 << 20
MAX_BROADCAST = 500_000
KEY = ["id", "id2"]
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def difference_cover(q: int) -> tuple[int, list[int]]:
    """(v, residues) with v = q * q + q + 1 and q + 1 residues whose differences are all residues modulo v: the powers of
    a generator of the field with q ** 3 elements that lie in a plane, q prime."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, seen, plane = (1, 0, 0), 0, []
                for i in range(v):  # times the root of x^3 = a x^2 + b x + c, up to the first power that is a number
                    if x[2] == 0:
                        plane.append(i)
                    if i and x[1] == x[2] == 0:
                        break
                    seen += 1
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if seen == v and len(plane) == q + 1 and len({(s - t) % v for s in plane for t in plane}) == v:
                    return v, plane
    raise ValueError(f"no difference cover for {q}")


class Windows:
    """Hashes of equally long windows of bytes, the same wherever the window stands."""

    def __init__(self, width: int, base: int):
        self.width = width
        n = SEGMENT + width
        inverse = pow(base, -1, 1 << 64)
        self.powers, self.inverses = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64)))) for x in (base, inverse))

    def hashes(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hashes of the windows at sorted places."""
        out = np.empty(len(places), np.uint64)
        at = 0
        while at < len(places):
            low = int(places[at])
            upto = int(np.searchsorted(places, low + SEGMENT))
            own = places[at:upto] - low
            piece = data[low : low + int(own[-1]) + self.width].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * self.powers[: len(piece)])))
            x = (sums[own + self.width] - sums[own]) * self.inverses[own]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[at:upto] = x ^ (x >> np.uint64(29))
            at = upto
        return out


class Anchors:
    """Per place the hash of the anchor of the window that starts there."""

    def __init__(self, width: int):
        self.gram = min(GRAM, width)
        self.wide, self.grams = width - self.gram + 1, Windows(self.gram, _BASE[1])

    def of(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For sorted places. Minima over stretches of equal length, from running minima of blocks of that length."""
        low, wide = int(places[0]), self.wide
        piece = data[low : int(places[-1]) + wide + self.gram - 1]
        x = (self.grams.hashes(piece, np.arange(len(piece) - self.gram + 1)) >> np.uint64(32)).astype(np.uint32)
        blocks = np.pad(x, (0, -len(x) % wide), constant_values=0xFFFFFFFF).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(blocks, axis=1).ravel()
        at = places - low
        return np.minimum(ahead[at], behind[at + wide - 1])


def _ties(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of h, where each rank starts in it, and how many places each rank has."""
    order = np.argsort(h, kind="stable")
    a = h[order]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(h) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(h)))


def _packed(x: np.ndarray) -> bytes:
    """Sorted or nearly sorted numbers in few bytes: their differences, compressed."""
    return zlib.compress(np.diff(x, prepend=x.dtype.type(0)).tobytes(), 1)


def _unpacked(parts: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.cumsum(np.frombuffer(zlib.decompress(x), kind), dtype=kind) for x in parts]])


#: A row of places: their bucket (-1: known to be repeated) and its part, how many, hashes (in `wide` bytes each), texts' keys
#: and how many places each has, offsets, and whether a place is known to be repeated.
_SENT = "bucket int, part int, n long, wide int, h binary, id binary, id2 binary, times binary, off binary, known binary"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _row(bucket: int, part: int, h: np.ndarray, id_: np.ndarray, id2: np.ndarray, off: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Places in the order of their texts as one row."""
    starts = np.flatnonzero(np.concatenate(([True], (id_[1:] != id_[:-1]) | (id2[1:] != id2[:-1]))))
    times = np.diff(starts, append=len(id_)).astype(np.uint32)
    blobs = [h.tobytes(), *map(_packed, (id_[starts], id2[starts].astype(np.uint32), times, off, known.view(np.uint8)))]
    ints = [pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([len(off)], pa.int64()), pa.array([h.itemsize], pa.int32())]
    return pa.RecordBatch.from_arrays([*ints, *[pa.array([v], pa.binary()) for v in blobs]], names=_SENT_NAMES)


def _places(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """h, id, id2, off and known of the places in rows."""

    def column(name: str, kind) -> np.ndarray:
        return _unpacked(rows.column(name).to_pylist(), kind)

    times = column("times", np.uint32)
    wide = rows.column("wide")[0].as_py() if rows.num_rows else 8
    h = np.frombuffer(b"".join(rows.column("h").to_pylist()), np.uint64 if wide == 8 else np.uint32)
    id_, id2 = np.repeat(column("id", np.int64), times), np.repeat(column("id2", np.uint32), times)
    return h, id_, id2.astype(np.int64), column("off", np.uint32), column("known", np.uint8).view(np.bool_)


class _Gathered:
    """Places that a task has found, sent on by bucket. short: half of a hash's bits will do."""

    def __init__(self, buckets: int, short: bool):
        self.buckets, self.short, self.parts, self.keys, self.n = buckets, short, [], [], 0

    def add(self, h: np.ndarray, anchor: np.ndarray, id_: int, id2: int, off: np.ndarray) -> None:
        self.parts.append((h, anchor, np.full(len(h), len(self.keys), np.int32), off.astype(np.uint32)))
        self.keys.append((id_, id2))
        self.n += len(h)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, anchor, text, off = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        id_, id2 = np.array(self.keys, np.int64).T
        self.parts, self.keys, self.n = [], [], 0
        order, starts, counts = _ties(h)
        rest = np.ones(len(h), bool)
        rest[order[starts]] = False
        known = np.zeros(len(h), bool)
        known[order[starts[counts > 1]]] = True
        if more := rest.any():
            x = np.flatnonzero(rest)  # in the order of texts and offsets, as they were gathered
            yield _row(-1, 0, np.zeros(0, np.uint64), id_[text[x]], id2[text[x]], off[x], np.zeros(0, bool))
        lead = np.flatnonzero(~rest) if more else np.arange(len(h))
        spread = (anchor[lead] * np.uint32(0x9E3779B1)) >> np.uint32(3)
        place = (spread % np.uint32(self.buckets)).astype(np.int32)
        by = np.argsort(place, kind="stable")
        lead, place = lead[by], place[by]
        ends = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for s, e in zip(ends, ends[1:], strict=False):
            x = lead[s:e]
            yield _row(int(place[s]), 0, (h[x] >> np.uint64(32)).astype(np.uint32) if self.short else h[x], id_[text[x]], id2[text[x]], off[x], known[x])


def _by_text(id_: np.ndarray, id2: np.ndarray, off: np.ndarray) -> pa.Table:
    """Places by text: id, id2, off (packed)."""
    by = np.lexsort((off, id2, id_))
    id_, id2, off = id_[by], id2[by], off[by]
    starts = np.flatnonzero(np.concatenate(([True], (id_[1:] != id_[:-1]) | (id2[1:] != id2[:-1])))) if len(id_) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(id_)) if len(id_) else starts
    return pa.table({"id": pa.array(id_[starts], pa.int64()), "id2": pa.array(id2[starts], pa.int64()), "off": pa.array([_packed(off[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())})


def _sorted_bucket(rows: pa.Table) -> pa.Table:
    """The places of one bucket that are repeated, by text."""
    h, id_, id2, off, known = _places(rows)
    order, _, counts = _ties(h)
    tied = known.copy()
    tied[order] |= np.repeat(counts > 1, counts)
    return _by_text(id_[tied], id2[tied], off[tied])


def _direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            _, id_, id2, off, _ = _places(batch.slice(i, 1))
            yield from _by_text(id_, id2, off).to_batches()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, dealt into `parts` by the places' hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            h, id_, id2, off, known = _places(row)
            part = (h * h.dtype.type(0x9E3779B1) >> h.dtype.type(7)) % h.dtype.type(row.column("parts")[0].as_py())
            for k in np.unique(part).tolist():
                x = np.flatnonzero(part == k)
                yield _row(row.column("bucket")[0].as_py(), int(k), h[x], id_[x], id2[x], off[x], known[x])


def _repeated(sent: DataFrame, bucket: int) -> DataFrame:
    """Per text (id, id2) its repeated places, as a list of packed arrays."""
    large = sent.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * bucket)
    large = large.select("bucket", F.ceil(F.col("n") / bucket).cast("int").alias("parts"))
    rows = sent.where("bucket >= 0").join(large, "bucket", "left")
    dealt = rows.where("parts IS NULL").select(*_SENT_NAMES).unionByName(rows.where("parts IS NOT NULL").mapInArrow(_split, _SENT))
    found = dealt.groupBy("bucket", "part").applyInArrow(_sorted_bucket, "id long, id2 long, off binary")
    known = sent.where("bucket < 0").mapInArrow(_direct, "id long, id2 long, off binary")
    return found.unionByName(known).groupBy(*KEY).agg(F.collect_list("off").alias("offs"))


def _offsets(offs: list[bytes]) -> np.ndarray:
    return np.sort(_unpacked(offs, np.uint32).astype(np.int64))


def _picked(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows whose key is (left_semi) or isn't (left_anti) among ids, which are broadcast if they are few enough."""
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, KEY, how)


def repeated_starts(texts: DataFrame, total: int, work: Scratch, length: int = LENGTH, order: int = ORDER, bucket: int = BUCKET) -> DataFrame:
    """Of different texts (id, id2, text): per text the places where repeated strings of `length` bytes start (offs)."""
    v, cover = difference_cover(order)
    width = length - v + 1
    if width < 1:
        raise ValueError(f"strings of {length} bytes are too short for a cover modulo {v}")
    residues = np.zeros(v, bool)
    residues[cover] = True

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, anchors, gathered = Windows(width, _BASE[0]), Anchors(width), _Gathered(buckets, short=True)
        for batch in slices(batches, "text"):
            for id_, id2, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) < length:
                    continue
                places = np.flatnonzero(np.resize(residues, len(data) - width + 1))
                if len(places):
                    gathered.add(windows.hashes(data, places), anchors.of(data, places), id_, id2, places)
                if gathered.n >= GATHERED:
                    yield from gathered.sent()
        yield from gathered.sent()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, anchors, gathered = Windows(length, _BASE[0]), Anchors(length), _Gathered(buckets, short=False)
        for batch in slices(batches, "text"):
            for id_, id2, text, offs in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "offs")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                ties = _offsets(offs)
                steps = np.zeros(len(data) + 2, np.int32)
                np.add.at(steps, np.maximum(0, ties - v + 1), 1)
                np.add.at(steps, ties + 1, -1)
                places = np.flatnonzero(np.cumsum(steps)[: len(data) - length + 1] > 0)
                for at in range(0, len(places), GATHERED):
                    some = places[at : at + GATHERED]
                    gathered.add(windows.hashes(data, some), anchors.of(data, some), id_, id2, some)
                    if gathered.n >= GATHERED:
                        yield from gathered.sent()
        yield from gathered.sent()

    buckets = max(1, round(total * len(cover) / v / bucket))
    # Saved before they are sorted: the buckets' sizes are known then.
    sent = work.save("sent", texts.mapInArrow(sampled, _SENT))
    ties = work.save("ties", _repeated(sent, bucket))
    work.drop("sent")
    near = _picked(texts, ties.select(*KEY), "left_semi").join(ties, KEY)
    sent = work.save("sent", near.mapInArrow(strings, _SENT))
    starts = work.save("starts", _repeated(sent, bucket))
    work.drop("sent", "ties")
    return starts


def removed_spans(offs: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal stretches that strings starting at the places cover."""
    at = np.unique(_offsets(offs))
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate(([0], breaks + 1))].tolist(), (at[np.append(breaks, len(at) - 1)] + length).tolist(), strict=True))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, order: int = ORDER, bucket: int = BUCKET, with_kept: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, spans (array of byte stretches start, end), kept_sha256; with
    with_kept also the bytes that remain (kept)."""
    work = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own"), text.alias("text"), F.xxhash64(text).alias("id"), F.crc32(text).alias("id2"))
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("size")).where(F.col("size") >= length)
    counts = work.save("counts", counts)
    total = counts.agg(F.sum("size")).first()[0] or 0
    copied = work.save("copied", counts.where("n > 1").select(*KEY))
    # Texts too short for a string stay out; equal texts take part once.
    long = rows.where(F.octet_length("text") >= length).select(*KEY, "text")
    once = _picked(long, copied, "left_anti").unionByName(_picked(long, copied, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")))
    starts = _picked(repeated_starts(once, total, work, length, order, bucket), copied, "left_anti")
    touched = work.save("touched", starts)
    work.drop("counts", "starts")

    span = "array<struct<start:bigint,end:bigint>>"
    whole = rows.select("own", F.octet_length("text").cast("long").alias("n_bytes"), "text", *KEY)
    clean = _picked(_picked(whole, copied, "left_anti"), touched.select(*KEY), "left_anti")
    gone = _picked(whole, copied, "left_semi")
    cut = _picked(_picked(whole, copied, "left_anti"), touched.select(*KEY), "left_semi").join(touched, KEY)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, offs in zip(batch.column("text").to_pylist(), batch.column("offs").to_pylist(), strict=True):
                data, spans = text.encode(), removed_spans(offs, length)
                kept = b"".join(data[e:s] for (_, e), (s, _) in zip([(0, 0), *spans], [*spans, (len(data), 0)], strict=True))
                out.append((len(data) - len(kept), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("n_bytes"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=["own", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    parts = [
        clean.select("own", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.array().cast(span).alias("spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.encode("text", "UTF-8").alias("kept")] * with_kept),
        gone.select("own", "n_bytes", F.col("n_bytes").alias("n_removed"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *[F.encode(F.lit(""), "UTF-8").alias("kept")] * with_kept),
        cut.select("own", "n_bytes", "text", "offs").mapInArrow(remove, f"own {kind}, n_bytes long, n_removed long, spans {span}, kept_sha256 string, kept binary").drop(*[] if with_kept else ["kept"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("own", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES, ORACLES = {"op8_suffix_dedup": op8_suffix_dedup}, {}
