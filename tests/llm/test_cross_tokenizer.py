import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from factlens.llm.cross_tokenizer import A_PATH, B_PATH, Alignment, Pair, align_tokens, byte_alphabet, op11_cross_tokenizer, read_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute():
    """Both tokenizers by their own libraries, token by token."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = byte_alphabet()

    def groups(text):
        if not text:
            return []
        ours = a.encode(" " + text, add_special_tokens=False).ids
        theirs = b.encode(text)
        x = [bytes(letters[c] for c in a.id_to_token(i)) for i in ours]
        y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(theirs, map(b.id_to_piece, theirs), strict=True)]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            return []
        out, i, j = [], 0, 0
        while i < len(ours):
            s, t, left, right = i, j, len(x[i]), len(y[j])
            while left != right:
                if left < right:
                    i += 1
                    left += len(x[i])
                else:
                    j += 1
                    right += len(y[j])
            i, j = i + 1, j + 1
            out.append((ours[s:i], theirs[t:j]))
        return out

    def rows(texts):
        found = [groups(t) for t in texts]
        count = Counter((g[0][-1], g[1][-1]) for f in found for g in f)
        top = Counter()
        for (_, y), n in count.items():
            top[y] = max(top[y], n)
        out = []
        for f in found:
            links = [(g[0][-1], g[1][-1]) for g in f]
            said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in f)
            out.append((sum(len(p) for p, _ in f), sum(len(q) for _, q in f), len(f), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if f else ""))
        return out, count, found

    return rows


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ü漢字🙂  \n\t.,'1234<>") for _ in range(rng.randrange(1, 12)))
    own = [" ".join(rng.choice(["the", "of", "quality", "Straße", "naïve", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", word()]) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    odd = [None, "", " ", "  ", "\n", "a", "x ▁ y", "▁", "\x00\x01", "é ﬁ ½", "​﻿", " lead", "trail ", "a" * 30_000, " " * 5_000, "word " * 9_000, "🙂" * 500]
    return own + odd + own[:3]


def test_by_brute_force(spark, brute):
    rows = texts()
    want, count, found = brute(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 AS id", "'z' AS blk", "3 AS n", "4 AS bucket").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in align_tokens(docs, groups="sha256").collect()}
    assert got == dict(enumerate(want))
    held = Alignment(docs, read_files())
    assert {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in held.documents().collect()} == {i: [(p, q) for p, q in f] for i, f in enumerate(found)}
    assert {(r.a, r.b): r.n for r in held.link_counts().collect()} == dict(count)
    assert want[rows.index("x ▁ y")][0] == 0 and want[rows.index("a" * 30_000)][0] > 0


def test_blocks_do_not_matter(spark, brute, monkeypatch):
    """Many blocks and a large one give the same."""
    rows = texts()
    want, _, _ = brute(rows)
    pair = Pair(read_files())
    x = pair.align([t or "" for t in rows])
    assert list(zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), pair.written(x), strict=True)) == [(*w[:3], w[6]) for w in want]
    for t, w in zip(rows, want, strict=True):
        x = pair.align([t or ""])
        assert (x.n_a[0], x.n_b[0], x.n_groups[0], pair.written(x)[0]) == (*w[:3], w[6])


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (None, "a b")], "doc_id long, text string")
    assert align_tokens(docs.limit(0)).count() == 0
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum, r.n_best) for r in align_tokens(docs).collect())
    assert got == [(0, 2, 4, 2), (0, 2, 4, 2), (1, 0, 0, 0)]
    with pytest.raises(ValueError, match="groups"):
        align_tokens(docs, groups="json")


def test_query_by_brute_force(spark, brute):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = brute([r.text for r in docs])
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in op11_cross_tokenizer(spark, SF).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}
