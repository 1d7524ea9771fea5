import random

import pytest

from factlens.llm.max_plus import BPE, CHUNK, NORMAL, UNIGRAM, Lattice, Model
from factlens.llm.sentencepiece_codec import MODEL_PATH, decode_ids, encode_texts, read_model

PARTS = ["a", "b", "aa", " ", "  ", "the", "ing", "\n", "é", "漢", "字", "x1", "==", "----", "Z", " th", "tion"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_the_library_for_any_chunks(library):
    lattice = Lattice(read_model())
    for text in texts(300):
        want = library.encode(text)
        for chunk in (1 << 16, 17, 4, 1):
            assert lattice.encode(text, chunk) == want, (chunk, text)
        assert lattice.decode(want) == text == library.decode(want)


def test_unigram_weights_by_brute_force():
    rng = random.Random(2)
    pieces = {p: -rng.randrange(1, 60) / 7 for p in ["▁", "a", "b", "ab", "ba", "aba", "bb", "▁a", "▁ab", "abab"]}
    model = Model(UNIGRAM, [("<unk>", 0.0, 2), *[(p, s, NORMAL) for p, s in pieces.items()]], True, False)
    lattice = Lattice(model)

    def best(s):
        if not s:
            return 0.0
        return max(pieces[s[:n]] + best(s[n:]) for n in range(1, 5) if s[:n] in pieces)

    for _ in range(200):
        text = "".join(rng.choice("aab ") for _ in range(rng.randrange(1, 14))).strip()
        for chunk in (1 << 16, 5, 1):
            ids = lattice.encode(text, chunk)
            assert abs(sum(model.pieces[i][1] for i in ids) - (best(lattice.prepared(text)) if text else 0)) < 1e-9
            assert lattice.decode(ids) == text
    assert read_model().kind == BPE


def test_frames(spark, library):
    rows = [(i, x) for i, x in enumerate(texts(40, 5))] + [(90, None), (91, ""), (91, ""), (92, "the " * 900 + "字" * 300), (92, "the " * 900 + "字" * 300), (93, "x" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS k", "1L AS rid")
    for giant, chunk in ((1 << 16, 1 << 15), (30, 100)):
        got = encode_texts(docs, giant=giant, chunk=chunk)
        assert sorted((r.doc_id, r.n_tokens, r.ids) for r in got.collect()) == sorted((i, len(y), y) for i, x in rows for y in [library.encode(x or "")])
        assert got.where("NOT round_trip").count() == 0
    assert {(r.doc_id, r.text) for r in decode_ids(got).collect()} == {(i, x or "") for i, x in rows}
    assert encode_texts(docs.limit(0)).count() == 0


def test_the_scan_carries_long_texts(spark, library):
    """Texts of over two chunks go through matrices and scan; they hold a good part of all characters."""
    lattice, scanned, every = Lattice(read_model()), 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text IS NOT NULL").collect():
        every += len(r.text)
        if len(r.text) > 2 * CHUNK:
            scanned += len(r.text)
            assert lattice.encode(r.text) == library.encode(r.text)
    assert scanned > 0.15 * every


def test_units_are_cut_between_letters_and_others(library):
    """Words are remembered without the marks around them, and frequent ones outlast rare ones; the ids stay the library's."""
    lattice = Lattice(read_model(), kept=40)
    rng = random.Random(8)
    marks = ["", ".", ",", "²", "².", "_", "1", "é", "́", "½", "\n", "!!", "字", "🙂", "▁", "  ", "٣"]
    for _ in range(400):
        text = " ".join(rng.choice(marks) + rng.choice(["word", "of", "Öl", "naïve", "x" * rng.randrange(1, 90)]) + rng.choice(marks) + rng.choice(marks) for _ in range(8))
        assert lattice.encode(text) == library.encode(text), text
    lattice = Lattice(read_model())
    lattice.encode("word. word, word!\nword; (word)")
    assert {u for u in lattice._unit_ids if "word" in u} == {"▁word", "word"}


def test_pieces_across_letters_and_marks_keep_units_whole():
    pieces = [("<unk>", 0.0, 2), *[(p, -float(i), NORMAL) for i, p in enumerate(["▁", "a", ".", "a.", "▁a."])]]
    for kind in (BPE, UNIGRAM):
        lattice = Lattice(Model(kind, pieces, True, False))
        assert lattice.split("▁a.▁a") == ["▁a.", "▁a"] and lattice.decode(lattice.encode("a. a")) == "a. a"
