import hashlib
import random
from collections import Counter

import numpy as np

from factlens.llm.suffix_dedup import ORDER, Windows, difference_cover, op8_suffix_dedup, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_cover():
    for q in (3, 5, ORDER):
        v, cover = difference_cover(q)
        assert len(cover) == q + 1
        assert all(any((i + s) % v in cover and (j + s) % v in cover for s in range(v)) for i in range(v) for j in range(0, v, 7))


def test_hashes_don_t_depend_on_place():
    data = np.frombuffer(random.Random(1).randbytes(2_500_000) + b"z" * 50, np.uint8).copy()
    data[2_200_000:2_200_090] = data[10:100]
    w = Windows(90, 0x9E3779B97F4A7C15)
    h = w.hashes(data, np.array([10, 11, 2_200_000, 2_200_001]))
    assert h[0] == h[2] and h[1] != h[3]


def corpus(rng, length):
    say = lambda n: "".join(rng.choice("abcdefgh é\n字") for _ in range(n))
    shared = [say(rng.randrange(length // 2, 3 * length)) for _ in range(8)]
    texts = []
    for _ in range(70):
        parts = [say(rng.randrange(3 * length)) for _ in range(rng.randrange(1, 4))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared)[rng.randrange(9) :])
        texts.append("".join(parts))
    base = say(6 * length)
    texts += [base[:k] + "#" + base[k:] for k in range(20, 6 * length, length)]
    return texts + ["ab" * length, "z" * (length + 3), "z" * (length - 1), "", None, None, texts[0], texts[0], say(length)]


def test_by_brute_force(spark):
    for length, order, bucket in ((60, 5, 40), (60, 5, 3000), (400, ORDER, 3000)):
        texts = corpus(random.Random(length), length)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 AS id", "'o' AS own")
        got = remove_repeats(docs, length=length, order=order, bucket=bucket, with_kept=True).collect()
        want = brute(texts, length)
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in got} == dict(enumerate(want))
    assert remove_repeats(docs.limit(0)).count() == 0


def test_few_or_no_repeats_in_many_buckets(spark):
    """Buckets in which nothing is repeated, all of them or all but one."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(20)]
    for more in ([], [texts[3][100:900] + "!"]):
        rows = [*texts, *more]
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        for bucket in (300, 400_000):
            got = remove_repeats(docs, bucket=bucket, with_kept=True).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in got} == dict(enumerate(brute(rows, 400)))


def test_planted_passages_show_in_n_removed_not_in_n_bytes(spark, tmp_path):
    """The query on passages of over 50 words that stand in several documents: those of 400 bytes or more go, shorter ones stay."""
    rng = random.Random(12)
    say = lambda n, wide: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, wide))) for _ in range(n))
    long, short, clean = say(90, 12), say(55, 6), ""
    assert len(short.encode()) < 390 < 410 < len(long.encode())
    planted = [long] * 8 + [short] * 8 + [clean] * 8
    texts = [f"{say(rng.randrange(20, 200), 9)} {x} {say(rng.randrange(20, 200), 9)}" for x in planted]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: x[:4] for i, x in enumerate(brute(texts, 400))}
    assert [got[i].n_removed > 0 for i in range(24)] == [x == long for x in planted]
    assert [got[i].n_bytes for i in range(24)] == [len(t.encode()) for t in texts]
