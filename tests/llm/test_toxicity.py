import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from factlens.llm.string_kernel import DECAY, LENGTH, Subsequences, _codes, kernel, words_of
from factlens.llm.toxicity import held_out, score_texts, train, training_rows

DATA = "/root/testdata/sf0.1"


def spans(word):
    out = defaultdict(float)
    for at in combinations(range(len(word)), LENGTH):
        out["".join(word[i] for i in at)] += DECAY ** (at[-1] - at[0] + 1)
    return out


def test_kernel_by_brute_force():
    words = ["idiot", "id-iot", "clown", "réeux", "banana", "ana", "abc", "ab", "zzz", "a" * 20]
    codes, _ = _codes(words)
    want = np.array([[sum(v * spans(b).get(k, 0) for k, v in spans(a).items()) for b in words] for a in words])
    assert np.allclose(kernel(codes, codes), want, rtol=1e-4)
    assert np.allclose(kernel(codes, codes, pairs=True), np.diag(want), rtol=1e-4)
    marks = [w for w in words if len(w) >= LENGTH]
    at = [words.index(w) for w in marks]
    norm = np.sqrt(np.maximum(np.diag(want), 1e-12))
    assert np.allclose(Subsequences(marks).values(words), (want / norm[:, None] / norm[None, :])[:, at], atol=1e-4)


def test_words():
    assert words_of("An *id-iot*, i d i o t!") == ["id-iot", "idiot"]
    assert max(map(len, words_of("x" * 95))) <= 20 and words_of(" .. ") == []


def test_held_out_recall(spark):
    """An answer that calls all texts clean has a recall of 0 and an area under the curve of a half."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scorer = train(training_rows(docs, labels))
    rows = score_texts(docs, scorer).join(labels, "doc_id").where(held_out(labels.doc_id)).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    bad, good = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([x >= 0.5 for x in bad]) >= 0.75 and np.mean([x >= 0.5 for x in good]) <= 0.01
    assert np.mean([(x > z) + (x == z) / 2 for x in bad for z in good]) >= 0.93


def test_gaps_and_empty(spark):
    rng = np.random.default_rng(0)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    say = lambda *more: " ".join([*rng.choice(filler, 20), *more])
    rows = [(say(w), 1) for w in ("moron", "idiot") for _ in range(40)] + [(say(), 0) for _ in range(200)] + [(None, 0)]
    scorer = train(spark.createDataFrame(rows, "text string, label int"))
    asked = [(1, say("moron")), (2, say("m.oron")), (3, "i d i o t"), (4, say("idi*ot")), (5, say()), (6, None), (7, ""), (7, ""), (7, "idiot")]
    docs = spark.createDataFrame(asked, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS label", "2 AS h")
    got = sorted((r.doc_id, r.score >= 0.5) for r in score_texts(docs, scorer).collect())
    assert got == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False), (7, False), (7, True)]
    assert score_texts(docs, train(docs.selectExpr("text", "0 AS label").limit(0))).where("score < 0.5").count() == len(asked)
    assert score_texts(docs.limit(0), scorer).count() == 0


def test_repeated_ids_count_as_pairs(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "two"), (1, "two"), (2, None), (3, "held out or not")], "doc_id long, text string").selectExpr("*", "0 AS label", "'c' AS toxic")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    free = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5}
    want = [x for x in [("one", 0), ("one", 1), ("two", 0), ("two", 1)] if 1 in free] + [("", 0)] * (2 in free)
    assert sorted((r.text, r.label) for r in training_rows(docs, labels).collect()) == sorted(want)


@pytest.mark.parametrize("label", [0, 1])
def test_single_class(spark, label):
    scorer = train(spark.createDataFrame([("a b c", label)], "text string, label int"))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert (score_texts(docs, scorer).first().score >= 0.5) == bool(label)


def test_two_scorers_in_one_session(spark):
    """Each scorer reads with its own landmarks, though Python workers are used again."""
    filler = ["alpha", "beta", "gamma", "delta", "omega"]
    say = lambda i, *more: " ".join([filler[i % 5], filler[i // 5 % 5], *more])
    docs = spark.createDataFrame([(1, say(1, "moron")), (2, say(2, "zwicker")), (3, say(3))], "doc_id long, text string")
    for _ in range(3):
        for bad, want in (("moron", [True, False, False]), ("zwicker", [False, True, False])):
            rows = [(say(i, bad), 1) for i in range(40)] + [(say(i), 0) for i in range(120)]
            scorer = train(spark.createDataFrame(rows, "text string, label int"))
            assert [r.score >= 0.5 for r in score_texts(docs, scorer).orderBy("doc_id").collect()] == want
            del scorer
