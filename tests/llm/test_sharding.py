import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from factlens.llm.sharding import assign_shards


def test_even_gapless_and_together(spark):
    texts = [f"text {i}" for i in range(300)] + [f"pair {i // 3}" for i in range(150)] + ["hot"] * 220 + [None, "", "é", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS h")
    rows = assign_shards(docs, 6, cell_rows=20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    where = defaultdict(Counter)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]][r.shard] += 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(where[f"pair {i}"]) == 1 for i in range(50)) and len(where["é"]) == 1
    assert sum(n for _, n in where["hot"].most_common(3)) == 220


def test_no_group_below_a_quota_is_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = assign_shards(docs).join(docs, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n"))
    assert rows.agg(F.max("shards"), F.max("n")).first()[0] == 1


def test_groups_that_fill_their_shards(spark):
    """Groups without documents beside them: as few as can be are cut, and the law still holds."""
    texts = [f"g{i % 7}" for i in range(70)] + [f"h{i // 5}" for i in range(30)] + ["x" * 200_000] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = assign_shards(docs, 10, cell_rows=3).collect()
    sizes, where = Counter(r.shard for r in rows), defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 102
    assert sum(len(x) > 1 for x in where.values()) <= 3 and len({(r.shard, r.slot) for r in rows}) == 102


def test_tiny_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in assign_shards(docs).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert assign_shards(docs.limit(0)).count() == 0


def cut_of(rows, links):
    where = {r.doc_id: r.shard for r in rows}
    return sum(w for a, b, w in links if where[a] != where[b])


def test_rounds_against_brute_force(spark):
    """The cut of a small graph is near the least that any even split has."""
    rng = random.Random(5)
    links = [(a, b, 3) for s in (0, 6) for a, b in combinations(range(s, s + 6), 2) if rng.random() < 0.8] + [(1, 7, 1), (4, 11, 1)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "doc_id long, text string")
    least = min(sum(w for a, b, w in links if (a in half) != (b in half)) for half in map(set, combinations(range(12), 6)))
    rows = assign_shards(docs, 2, links=spark.createDataFrame(links, "a long, b long, weight long")).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [6, 6] and cut_of(rows, links) <= 2 * least


def test_rounds_keep_communities_together(spark):
    """Communities of documents with different texts, tied by links that take several rounds to run along."""
    rng = random.Random(6)
    n, size = 480, 12
    links = []
    for s in range(0, n, size):
        links += [(s + i, s + i + 1, 2) for i in range(size - 1)] + [(s + rng.randrange(size), s + rng.randrange(size), 1) for _ in range(30)]
    links += [(rng.randrange(n), rng.randrange(n), 1) for _ in range(60)]
    ids = rng.sample(range(10_000), n)
    named = [(ids[a], ids[b], w) for a, b, w in links]
    rows = [(i, f"t{i}") for i in ids] + [(20_000 + i, "same") for i in range(15)] + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS w")
    odd = [(1, None, 1), (None, None, 1), (77_777, 88_888, 1), (ids[0], ids[0], 5)]
    given = spark.createDataFrame(named + odd, "a long, b long, weight long").repartition(3)
    got = assign_shards(docs, 8, links=given, cell_rows=50).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len({(r.shard, r.slot) for r in got}) == len(rows)
    assert len({r.shard for r in got if (r.doc_id or 0) >= 20_000}) == 1
    total, none = sum(w for a, b, w in named if a != b), cut_of(assign_shards(docs, 8).collect(), named)
    once = cut_of(assign_shards(docs, 8, links=given, rounds=1).collect(), named)
    assert cut_of(got, named) < 0.4 * total < none and cut_of(got, named) < once
    assert assign_shards(docs.limit(0), links=given).count() == 0
    assert len(assign_shards(docs, 8, links=given.limit(0)).collect()) == len(rows)


def test_rounds_gather_equal_texts(spark, monkeypatch):
    """Without the packing that comes after them, rounds bring equal texts together as far as quotas allow."""
    from factlens.llm import sharding

    monkeypatch.setattr(sharding, "_placed", lambda groups, *more: groups.select(*sharding.KEY, F.col("target").alias("to")).limit(0))
    texts = [f"text {i}" for i in range(300)] + [f"copy {i // 4}" for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def cut(rounds):
        where = defaultdict(set)
        rows = assign_shards(docs, 6, cell_rows=20, rounds=rounds).collect()
        sizes = Counter(r.shard for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r.shard, r.slot) for r in rows}) == len(texts)
        for r in rows:
            where[texts[r.doc_id]].add(r.shard)
        return sum(len(x) > 1 for x in where.values())

    assert cut(rounds=0) > 40 > 15 > cut(rounds=12)
