import random
from itertools import combinations

import numpy as np
import pytest

from factlens.llm.near_dedup import AGREE, FIVE, LONG, SHINGLE, Sketcher, components, deduplicated, labelled, near_duplicates, similar, within, words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_by_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        want = distance(a, b)
        for most in (0, 1, 2, 4, 12):
            assert within(a, b, most) == (want if want <= most else None), (a, b, most)


def test_sketches_know_order():
    words = [f"w{i}" for i in range(60)]
    one = Sketcher()
    same = lambda x, y: len(np.intersect1d(one.signatures(one.hashes(x)), one.signatures(one.hashes(y))))
    assert same(words, words) == FIVE + LONG > same(words, words[30:] + words[:30])
    assert len(set(labelled(one.hashes(["a"] * 20), SHINGLE).tolist())) == 16


def corpus(rng):
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    texts = []
    for _ in range(25):
        base = say(rng.randrange(40, 160))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            texts.append([w if rng.random() > 0.04 else "new" + w for w in base])
    hot = say(80)
    texts += [[w if rng.random() > 0.03 else f"x{rng.randrange(99)}" for w in hot] for _ in range(60)]
    return [" ".join(x) for x in texts]


def test_classes_by_brute_force(spark):
    texts = corpus(random.Random(6))
    texts += [texts[0], texts[0], "", "", " ", None, None, "one two", "one two", "one three"]
    n = len(texts)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(n), 2):
        a, b = texts[i], texts[j]
        if a is not None and b is not None and (a == b or words_of(a) and words_of(b) and similar(a, b)):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS sig")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in range(n)}
    kept = deduplicated(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("text IS NOT NULL").collect()) == sorted({root(i) for i in range(n) if texts[i] is not None})
    assert near_duplicates(docs.limit(0)).count() == 0 == deduplicated(docs.limit(0)).count()


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"z", b"y"), (b"y", b"y")]
    got = {r.n: r.label for r in components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert {bytes(k): bytes(v) for k, v in got.items()} == {**{bytes([i]): b"\x00" for i in range(21)}, b"z": b"y", b"y": b"y"}


def linked(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_duplicates(docs, **options).collect()}


def test_pairs_beside_a_common_passage(spark):
    """Texts that share most of their length with many others, and a pair that only its own words tell apart."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(55)]
    texts = [passage + [f"o{rng.randrange(10**9)}" for _ in range(20)] for _ in range(80)]
    copy = [w if i not in (55, 60, 65, 70) else f"n{i}" for i, w in enumerate(texts[40])]
    texts.append(copy)
    assert linked(spark, [" ".join(x) for x in texts]) == {i: 40 if i == 80 else i for i in range(81)}


def test_pairs_behind_a_leader_of_one(spark):
    """Versions that lose their beginning: the last is similar to the second only, and one bucket may be led by the first."""
    texts = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(100)]
        texts += [base, base[15:], base[29:]]
    assert linked(spark, [" ".join(x) for x in texts], block=1) == {i: i // 3 * 3 for i in range(90)}


def test_pairs_at_the_threshold(spark):
    """Pairs with edit similarity of 0.8 to 0.9 whose changed words are spread, in long and short texts."""
    rng = random.Random(10)
    texts = []
    for n, changed in ((100, range(4, 100, 5)), (10, [4]), (20, range(4, 20, 5)), (30, range(4, 29, 5)), (5, [2]), (4, [4])):
        for _ in range(20):
            one = [f"o{rng.randrange(10**9)}" for _ in range(n)]
            texts += [one, [f"n{i}" if i in changed else w for i, w in enumerate(one)] + ["more"] * (n == 4)]
    assert linked(spark, [" ".join(x) for x in texts]) == {i: i // 2 * 2 for i in range(len(texts))}


def test_many_pairs_below_the_threshold(spark):
    """Texts that are all nearly similar to each other, and some that are: only these are linked."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    texts = [[w if rng.random() > 0.14 else f"o{rng.randrange(10**9)}" for w in base] for _ in range(90)]
    want = list(range(90))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i, j in combinations(range(90), 2):
        if similar(" ".join(texts[i]), " ".join(texts[j])):
            x, y = sorted((root(i), root(j)))
            want[y] = x
    assert 5 < len({root(i) for i in range(90)}) < 85
    assert linked(spark, [" ".join(x) for x in texts], block=20) == {i: root(i) for i in range(90)}


def edited(rng, words, edits):
    """words after `edits` insertions, deletions or replacements of words drawn anywhere."""
    out = list(words)
    for k in range(edits):
        at, fresh = rng.randrange(len(out)), f"n{rng.randrange(10**9)}"
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [fresh] * (kind != 1)
    return out


@pytest.mark.parametrize("n", [5, 6, 8, 10, 12, 13, 20, 30, 32, 33, 40, 100, 300, 1000])
def test_recall_of_planted_pairs(n):
    """The share of similar pairs that meet in a bucket and whose sketches agree: both are all that candidates need."""
    rng, sketcher = random.Random(n), Sketcher()
    for least in (0.8, 0.85, 0.9, 0.95):
        edits = int((1 - least) * n + 1e-9)
        if not edits:
            continue
        met = total = 0
        while total < 60:
            one = [f"o{rng.randrange(10**9)}" for _ in range(n)]
            two = edited(rng, one, edits)
            if within(one, two, int(0.2 * max(len(one), len(two)) + 1e-9)) is None:
                continue
            total += 1
            a, b = (sketcher.hashes(x) for x in (one, two))
            agree = sum(x == y for x, y in zip(sketcher.sketch(a), sketcher.sketch(b), strict=True))
            met += bool(len(np.intersect1d(sketcher.signatures(a), sketcher.signatures(b)))) and agree >= AGREE
        assert met >= 0.95 * total, (least, met, total)
