import random

import pytest

from factlens.operators.similarity import similar_sets, token_sets


def brute(names, least):
    sets = {" ".join(sorted(w)): w for w in ({x for x in n.split() if len(x) > 2} for n in names) if w}
    keys = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > least}


@pytest.mark.parametrize("least", [0.2, 0.4, 0.5, 0.75, 0.9])
def test_by_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    words = [f"w{min(rng.randrange(16), rng.randrange(16)):02d}" for _ in range(500)]
    names = [" ".join(rng.sample(words, rng.randrange(1, 18))) for _ in range(300)] + ["of it", "", "w01", "w01 w02", "w02 w01"]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string").repartition(3)
    got = similar_sets(token_sets(rows), least).collect()
    assert len(got) == len({(r.a_key, r.b_key) for r in got})
    want = brute(names, least)
    assert {(r.a_key, r.b_key): round(r.likeness, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(want) > 3


def test_a_hot_token_makes_no_pairs(spark):
    """Thousands of two-token sets share one token: none are alike, and none meet."""
    rows = spark.range(4000).selectExpr("concat('policy n', lpad(id, 5, '0')) AS name")
    found = similar_sets(token_sets(rows), 0.4)
    assert found.count() == 0
    assert similar_sets(token_sets(rows.limit(0))).count() == 0
    more = spark.createDataFrame([("policy",)], "name string")
    assert similar_sets(token_sets(rows.unionByName(more)), 0.4).count() == 4000
