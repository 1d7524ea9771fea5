"""Sharding by balanced label propagation, under the law `rows`: the shards' row counts differ by one at most.

Linked documents have equal texts (null counts as empty), or are linked by a given table of links between ids. Each document
starts in the shard that its id hashes to: its label.

Rounds among equal texts: in each round a document counts the labels of its text's documents and wishes for the one that most of
them have (ties by a hash). Those of a text with the same label wish alike and are counted as one part, so a round's work is at
most `shards` parts a text. Wishes are granted as far as the wished shard has room (up to SLACK of a quota beyond it for the time)
or gives back as many rows: those that gain most are ranked first. Rounds end when nobody wishes, no wish is granted, or after
ROUNDS. Then a group of documents with equal texts is one node, whose label is that of most of it.

Rounds of propagation: over the links between groups, each group counts its neighbours' labels by the links' weights and wishes for
the label that most of them have, if that is more than its own label has. Wishes are granted as among equal texts. A shard beyond its
quota also lets groups go that gain nothing, those first that lose least. In each round a group moves only if its turn (a hash of group and round) has come, so that two neighbours don't swap labels for ever. Rounds end when no
wish is granted, or after ROUNDS. Without given links only the rounds among equal texts are run.

Then groups of two documents or more, and groups with links, are placed as wholes in the shard of their label, as far as the
shard's quota leaves room: they are ranked, large ones first, and those whose ranks' rows fit are placed. The others take the shard
with room that most of their placed neighbours are in, or else are drawn to shards with room left, in proportion to it, and so on
until no more group fits. A group is cut only if it is larger than a quota (it is dealt into chunks below one first) or if no
shard has room for it at the end.

Documents without links make the counts exact (quotas are rows // shards, one more for the first rows % shards): a shard's
documents are ranked, those without links last; what ranks beyond the quota fills the shards with room, in order. Ranks
come from bounded cells with prefix sums over the cells' counts, so no task sees a whole shard or group.

Edge cases: repeated rows are documents of their own; null ids hash like any value and are linked to nothing; links of unknown ids,
of an id to itself and null ones count for nothing, repeated ones add up, and a link of an id that several rows have holds for
all of them; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm.common import Scratch, table

SHARDS = 24
#: Rounds of propagation at most, how far a shard may be over its quota meanwhile, and in how many turns groups move.
ROUNDS, SLACK, TURNS = 12, 0.1, 2
#: Rows or groups in a cell.
CELL_ROWS = 20_000
KEY = ["h", "crc", "size", "chunk"]


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def _uniform(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _ranked(rows: DataFrame, by: list[str], cells: int, hashed: list, order: list, weight: Column) -> DataFrame:
    """rows with the summed weights of the rows before them (`start`) among those with the same first of `by`, in the order of
    the rest of `by`, then of cells, then of `order`."""
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(3), *hashed), F.lit(cells)).cast("int")).withColumn("w", weight)
    sums = dealt.groupBy(*by, "cell").agg(F.sum("w").alias("sum"))
    before = Window.partitionBy(by[0]).orderBy(*by[1:], "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "cell", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(*by, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("w").over(own), F.lit(0)))
    return inside.join(starts, [*by, "cell"]).withColumn("start", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside", "cell", "w")


def _drawn(room: list[int], u: Column) -> Column:
    """A shard with room, in proportion to it."""
    total, at, out = sum(room), 0, F.lit(max(range(len(room)), key=room.__getitem__))
    marks = []
    for s, n in enumerate(room):
        at += n
        if n:
            marks.append((at / total, s))
    for mark, s in reversed(marks):
        out = F.when(u < mark, F.lit(s)).otherwise(out)
    return out


def _votes(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """Per group and shard the weights of its ties (KEY, o_KEY, w) to groups with that label: KEY, label, votes."""
    other = labels.select(*[F.col(c).alias(f"o_{c}") for c in KEY], "label")
    return ties.join(other, [f"o_{c}" for c in KEY]).groupBy(*KEY, "label").agg(F.sum("w").alias("votes"))


def _ways(wished: dict[int, int], room: list[int]) -> list[int]:
    """How many rows may go each way (from shard * shards + to shard): as many as wish to come back, and of the room that is left
    where they go a share by what is left to go there."""
    shards = len(room)
    out = [min(wished.get(a * shards + b, 0), wished.get(b * shards + a, 0)) for a in range(shards) for b in range(shards)]
    left = [wished.get(k, 0) - n for k, n in enumerate(out)]
    for b in range(shards):
        into = sum(left[b::shards])
        for k in range(b, shards * shards, shards):
            out[k] += min(left[k], room[b] * left[k] // into) if into else 0
    return out


def _most() -> Column:
    """The label that most of a group's rows (n) have, ties by a hash: n, tie, label."""
    return F.max(F.struct("n", F.xxhash64("h", "chunk", "label").alias("tie"), "label"))


def _gathered(parts: DataFrame, quota: list[int], work: Scratch, cell_rows: int, rounds: int) -> DataFrame:
    """Parts of groups of equal texts (KEY, the shard they started in, label, n) with the labels that rounds of propagation
    among equal texts end in."""
    parts = work.save("parts", parts)
    most = [int(q * (1 + SLACK)) + 1 for q in quota]
    cells = max(1, -(-parts.count() // (len(quota) * cell_rows)))
    for _ in range(rounds):
        load = {r["label"]: r["n"] for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        sums = parts.groupBy(*KEY, "label").agg(F.sum("n").alias("n"))
        best = sums.groupBy(*KEY).agg(_most().alias("b"))
        movers = sums.join(best, KEY).where(F.col("label") != F.col("b.label")).select(*KEY, "n", "label", F.col("b.label").alias("wish"), (F.col("b.n") - F.col("n") + 1).alias("gain"))
        movers = work.save("movers", movers.withColumn("way", F.col("label") * len(quota) + F.col("wish")).withColumn("small", -F.floor(F.log2(F.col("gain") + 1))))
        wished = {r["way"]: r["n"] for r in movers.groupBy("way").agg(F.sum("n").alias("n")).collect()}
        if not wished:
            break
        ways = _ways(wished, [max(0, m - load.get(s, 0)) for s, m in enumerate(most)])
        ranked = _ranked(movers, ["way", "small"], cells, KEY, [F.desc("gain"), *KEY], F.col("n"))
        moved = work.save("moved", ranked.where(F.col("start") + F.col("n") <= _pick(ways, F.col("way"))).select(*KEY, "label", "wish"))
        if moved.isEmpty():
            break
        parts = work.save("parts", parts.join(moved, [*KEY, "label"], "left").select(*KEY, "shard", F.coalesce("wish", "label").alias("label"), "n"))
    return parts


def _propagated(groups: DataFrame, ties: DataFrame, quota: list[int], work: Scratch, cell_rows: int, rounds: int) -> DataFrame:
    """Groups (KEY, n, target) with the targets that rounds of propagation end in."""
    labels = work.save("labels", groups.withColumnRenamed("target", "label"))
    most = [int(q * (1 + SLACK)) + 1 for q in quota]
    cells = max(1, -(-labels.count() // (len(quota) * cell_rows)))
    idle = 0
    for turn in range(rounds * TURNS):
        load = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, m - load.get(s, 0)) for s, m in enumerate(most)]
        votes = _votes(ties, labels).withColumnRenamed("label", "wish")
        own = labels.select(*KEY, "n", "label").where(F.pmod(F.xxhash64(F.lit(turn // TURNS), *KEY), F.lit(TURNS)) == turn % TURNS)
        # Room is given out anew in each round; two shards also swap what wishes to go either way.
        other = F.when(F.col("wish") != F.col("label"), F.struct("votes", F.xxhash64(*KEY, "wish").alias("tie"), "wish"))
        has = F.coalesce(F.max(F.when(F.col("wish") == F.col("label"), F.col("votes"))), F.lit(0))
        best = votes.join(own, KEY).groupBy(*KEY, "n", "label").agg(F.max(other).alias("b"), has.alias("has")).where("b IS NOT NULL")
        surplus = [max(0, load.get(s, 0) - q) for s, q in enumerate(quota)]
        movers = best.select(*KEY, "n", "label", F.col("b.wish").alias("wish"), (F.col("b.votes") - F.col("has")).alias("gain")).where((F.col("gain") > 0) | (_pick(surplus, F.col("label")) > 0))
        movers = movers.withColumn("way", F.col("label") * len(quota) + F.col("wish")).withColumn("small", F.when(F.col("gain") > 0, -F.floor(F.log2(F.col("gain") + 1))).otherwise(1))
        movers = work.save("movers", movers)
        wished, forced = ({r["way"]: r[c] or 0 for r in movers.groupBy("way").agg(F.sum(F.when(F.col("gain") > 0, F.col("n"))).alias("n"), F.sum("n").alias("all")).collect()} for c in ("n", "all"))
        ways = _ways(wished, room)
        # A shard beyond its quota lets those go that lose least by it.
        out = [sum(forced.get(a * len(quota) + b, 0) for b in range(len(quota))) for a in range(len(quota))]
        forced = [surplus[k // len(quota)] * forced.get(k, 0) // max(1, out[k // len(quota)]) for k in range(len(ways))]
        ranked = _ranked(movers, ["way", "small"], cells, KEY, [F.desc("gain"), *KEY], F.col("n"))
        upto = F.when(F.col("gain") > 0, F.greatest(_pick(ways, F.col("way")), _pick(forced, F.col("way")))).otherwise(_pick(forced, F.col("way")))
        moved = work.save("moved", ranked.where(F.col("start") + F.col("n") <= upto).select(*KEY, "wish"))
        idle = idle + 1 if moved.isEmpty() else 0
        if idle == TURNS:
            break
        if not idle:
            labels = work.save("labels", labels.join(moved, KEY, "left").select(*KEY, "n", F.coalesce("wish", "label").alias("label")))
    return labels.withColumnRenamed("label", "target")


def _placed(groups: DataFrame, quota: list[int], work: Scratch, cell_rows: int, ties: DataFrame | None = None) -> DataFrame:
    """Groups (KEY, n, target) that find room as a whole: KEY, to."""
    room, done, turn, left = list(quota), None, 0, groups
    while True:
        count = left.count()
        if not count:
            break
        cells = max(1, -(-count // (len(room) * cell_rows)))
        fits = left.where(F.col("n") <= _pick(room, F.col("target"))).withColumn("small", -F.floor(F.log2("n")))
        ranked = _ranked(fits, ["target", "small"], cells, KEY, ["n", *KEY], F.col("n"))
        taken = ranked.where(F.col("start") + F.col("n") <= _pick(room, F.col("target"))).select(*KEY, "n", F.col("target").alias("to"))
        taken = work.save(f"taken{turn}", taken)
        used = {r["to"]: r["n"] for r in taken.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        done = taken if done is None else done.unionByName(taken)
        room = [n - used.get(s, 0) for s, n in enumerate(room)]
        if not used and turn or not any(room):
            break
        turn += 1
        rest = left.join(taken.select(*KEY), KEY, "left_anti").select(*KEY, "n", _drawn(room, _uniform(F.lit(turn), *KEY)).alias("target"))
        if ties is not None:  # to its placed neighbours rather, if their shard has room
            votes = _votes(ties, done.withColumnRenamed("to", "label")).where(_pick(room, F.col("label")) > 0)
            near = votes.groupBy(*KEY).agg(F.max(F.struct("votes", "label")).alias("b")).select(*KEY, F.col("b.label").alias("near"))
            rest = rest.join(near, KEY, "left").select(*KEY, "n", F.when(F.col("n") <= _pick(room, F.col("near")), F.col("near")).otherwise(F.col("target")).alias("target"))
        left = work.save("left", rest.where(F.col("n") <= max(room)))
    return groups.select(*KEY, F.lit(None).cast("int").alias("to")).limit(0) if done is None else done.select(*KEY, "to")


def _ties(links: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links (a, b, weight) between ids as ties between groups, in both directions: KEY, o_KEY, w."""
    ends = keyed.where("id IS NOT NULL").select("id", *KEY)
    other = ends.select(F.col("id").alias("b"), *[F.col(c).alias(f"o_{c}") for c in KEY])
    both = links.select("a", "b", "weight").where("a != b AND weight > 0").join(ends.withColumnRenamed("id", "a"), "a").join(other, "b")
    both = both.select(*KEY, *[f"o_{c}" for c in KEY], F.col("weight").alias("w"))
    turned = both.select(*[F.col(f"o_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"o_{c}") for c in KEY], "w")
    apart = ~F.lit(True)
    for c in KEY:
        apart = apart | (F.col(c) != F.col(f"o_{c}"))
    return both.unionByName(turned).where(apart).groupBy(*KEY, *[f"o_{c}" for c in KEY]).agg(F.sum("w").alias("w"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", links: DataFrame | None = None, rounds: int = ROUNDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of docs: id_col, size (UTF-8 bytes plus 8), text_crc32, shard, slot (gapless from 0). links: pairs of ids (a, b)
    that belong together, perhaps with a whole `weight`, besides equal texts."""
    work = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"))
    rows = work.save("rows", rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, total // shards)
    # Groups larger than a quota: about `shards` of them at most. A chunk is a tenth below a quota on average.
    large = rows.groupBy("h", "crc", "size").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = work.save("large", large.select("h", "crc", "size", F.ceil(F.col("n") / (0.9 * most)).alias("chunks")))
    keyed = rows.join(F.broadcast(large), ["h", "crc", "size"], "left")
    keyed = keyed.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "id"), "chunks"), F.lit(0)).cast("int")).drop("chunks")
    counts = keyed.groupBy(*KEY, "shard").agg(F.count("*").alias("n")).withColumn("label", F.col("shard"))
    copied = counts.groupBy(*KEY).agg(F.sum("n").alias("of")).where("of > 1").drop("of")
    parts = _gathered(counts.join(copied, KEY), quota, work, cell_rows, rounds)
    ties = None
    if links is not None:
        weight = F.col("weight").cast("long") if "weight" in links.columns else F.lit(1).cast("long")
        ties = work.save("ties", _ties(links.select("a", "b", weight.alias("weight")), keyed))
        alone = counts.join(copied, KEY, "left_anti").join(ties.select(*KEY).distinct(), KEY)
        parts = parts.unionByName(alone)
    groups = parts.groupBy(*KEY, "label").agg(F.sum("n").alias("n")).groupBy(*KEY).agg(F.sum("n").alias("n"), _most().getField("label").alias("target"))
    groups = work.save("groups", groups)
    if ties is not None:
        groups = _propagated(groups, ties, quota, work, cell_rows, rounds)
    placed = _placed(groups, quota, work, cell_rows, ties)
    # Parts go where their group does, or else where their rounds ended. A chunk has at most about a quota's rows, and Spark
    # splits what is hot in a join.
    ends = parts.drop("n").join(placed, KEY, "left")
    state = keyed.join(ends, [*KEY, "shard"], "left").withColumn("late", F.col("to").isNull().cast("int")).withColumn("shard", F.coalesce("to", "label", "shard")).drop("to", "label")
    out = _filled(work.save("state", state), quota, cell_rows, id_col)
    work.drop("rows", "groups", "parts", "left")
    return out


def _filled(state: DataFrame, quota: list[int], cell_rows: int, id_col: str) -> DataFrame:
    """Shards and slots under exact quotas."""
    shards = len(quota)
    cells = max(1, -(-sum(quota) // (shards * cell_rows)))
    load = [0] * shards
    for x in state.groupBy("shard").count().collect():
        load[x["shard"]] = x["count"]
    over, room, o, d = [], [], 0, 0
    for s in range(shards):
        over.append(o)
        room.append(d)
        o += max(0, load[s] - quota[s])
        d += max(0, quota[s] - load[s])
    place = F.col("start")
    spare = F.when(place >= _pick(quota, F.col("shard")), place - _pick(quota, F.col("shard")) + _pick(over, F.col("shard")))
    open_ = [s for s in range(shards) if quota[s] > load[s]]
    to = reduce(lambda w, s: w.when(F.col("spare") < room[s] + quota[s] - load[s], F.lit(s)), open_, F.when(F.col("spare").isNull(), F.col("shard")))
    ranked = _ranked(state, ["shard", "late"], cells, ["id", *KEY], ["id", *KEY], F.lit(1))
    out = ranked.withColumn("spare", spare).withColumn("to", to)
    slot = F.when(F.col("spare").isNull(), place).otherwise(F.col("spare") - _pick(room, F.col("to")) + _pick(load, F.col("to")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("to").alias("shard"), slot.cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES, ORACLES = {"op6_sharding": op6_sharding}, {}
