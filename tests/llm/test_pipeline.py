import math
import re
from itertools import combinations

import sentencepiece
from test_rules import plain_fit

import corpus_pipeline
from factlens.llm import quality_rules
from factlens.llm.decontamination import words_of as plain_words
from factlens.llm.near_dedup import similar, words_of
from factlens.llm.quality_rules import fit_references, judge_quality
from factlens.llm.secret_scans import RULES, Scanner, redacted
from factlens.llm.sentencepiece_codec import MODEL_PATH

SF = "/root/testdata/sf0.001"


def test_run_by_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in judge_quality(docs, fit_references(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = {i: set(words_of(t)) for i, t in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if len(words[i] & words[j]) * 2 > min(len(words[i]), len(words[j])) and similar(a, b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    rows = [(i, t) for i, t in rows if find(i) == i]
    lengths = {min(13, len(x)) for x in items if x}
    windows = {tuple(x[k : k + min(13, len(x))]) for x in items if x for k in range(len(x) - min(13, len(x)) + 1)}
    clean = []
    for i, text in rows:
        own = plain_words(text)
        hit = {p + k for n in lengths for p in range(len(own) - n + 1) if tuple(own[p : p + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(own):
            clean.append((i, text))
    finder, library = Scanner(), sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    want = {i: library.encode(redacted(t, finder.spans(t), RULES)) for i, t in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, odd, SF).count() == 2
    assert re.match("[a-z]", corpus_pipeline.STAGES[0][0])


def test_quality_stage_fits_on_all_labelled_rows(spark, tmp_path, monkeypatch):
    """More rows of a language and more languages than op9's sample has, labelled twice, or without an id or a language."""
    text = lambda i: " ".join(f"{a}{b}" for a in ("wort", "Satz", chr(97 + i % 26) * 3) for b in ("", "e", "en", "t.")) + " 12"
    rows = [(i, "en", text(i)) for i in range(700)] + [(1000 + i, f"l{i}", text(i) * 120) for i in range(45)] + [(2000, None, text(1)), (None, "en", text(2)), (2001, "en", None)]
    labels = [(i, 1) for i, *_ in rows if i is None or i % 7] + [(i, 0) for i, *_ in rows if i is not None and i % 7 == 0] + [(8, 1), (9, None), (5000, 1)]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, lang string, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = {i for i, k in labels if k == 1 and i is not None}
    want = plain_fit([(i, lang, t or "") for i, lang, t in rows if i is not None and lang], good, most=None)
    fitted = []
    monkeypatch.setattr(corpus_pipeline, "judge_quality", lambda docs, references, keep: fitted.append(references) or judge_quality(docs, references, keep=keep))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for most in (1_000_000, 1):
        monkeypatch.setattr(quality_rules, "MOST_SENT_IDS", most)
        assert corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).columns == docs.columns
        got = fitted.pop()
        assert set(got) == set(want) and len(want) > 36
        for lang, (classes, words) in want.items():
            assert all(map(math.isclose, got[lang][0], classes)) and list(got[lang][1]) == list(words), lang
            assert all(map(math.isclose, got[lang][1].values(), words.values()))
