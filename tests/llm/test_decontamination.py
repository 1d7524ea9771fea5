import random

from factlens.llm.decontamination import Windows, contaminated, decontaminate, find_contamination, n_hit, words_of


def brute(text, items):
    words, hit, which = words_of(text), set(), set()
    for item, other in items:
        own = words_of(other)
        n = min(13, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    which.add(str(item))
    return len(words), len(hit), sorted(which)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["Ab", "b", "c-d", "é", "漢字", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([2, 5, 14, 20, 30]))) for i in range(8)] + [(8, ""), (9, None), (10, say(14)), (10, None)]
    texts = [say(rng.randrange(60)) + (" " + items[rng.randrange(8)][1]) * rng.randrange(2) for _ in range(60)] + ["", None, items[2][1].upper(), items[2][1].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS hits", "2 AS item")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 10):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_contamination(docs, bench, max_windows=most).select("*", n_hit().alias("n_hit")).collect()}
        assert got == {i: brute(x, items) for i, x in enumerate(texts)}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in find_contamination(docs, bench).where(contaminated()).collect()}
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad
    assert decontaminate(docs, bench, remove="spans").count() == len(texts)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, bench).first().hits == []
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert Windows([]).find(["a"]) == ([], set())


def test_items_without_ids_hit_but_have_no_name(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS id", "'h' AS hits")
    items = spark.createDataFrame([(None, "one two three"), (None, None), (7, "y")], "item_id long, text string").selectExpr("*", "1 AS item")
    got = {r.doc_id: (r.n_words, [(h.start, h.end) for h in r.hits], r["items"]) for r in find_contamination(docs, items).collect()}
    assert got == {1: (5, [(1, 5)], ["7"]), 2: (0, [], []), 3: (0, [], [])}


def test_benchmarks_and_blocks_in_one_session(spark):
    """Workers that are used again keep no other block's windows."""
    docs = spark.createDataFrame([(i, f"say w{i} v{i} end") for i in range(12)], "doc_id long, text string")
    for turn in range(3):
        items = [(i, f"w{i} v{i}") for i in range(turn, 12, 3)]
        for most in (1, 2, 100):
            found = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), max_windows=most)
            assert {r.doc_id for r in found.where("size(items) > 0").collect()} == {i for i, _ in items}


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. One, two three! And that."), (2, None), (3, "one two threes"), (4, "ONE two three one two three")], "doc_id long, text string").selectExpr("*", "5 AS hits")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.hits) for r in decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: ("Keep this. ! And that.", 5), 2: (None, 5), 3: ("one two threes", 5), 4: ("", 5)}
