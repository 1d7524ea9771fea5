import random
import re

from factlens.llm.secret_scans import BASE, RULES, Scanner, find_secrets, redact_secrets

OWN = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(OWN.items()):
        out += [(m.start(), k, m.end()) for m in rx.finditer(text) if len(m[m.re.groups]) >= LEAST[kind]]
    return sorted(out)


def test_spans_equal_a_regex_engine():
    rng, finder = random.Random(1), Scanner(BASE)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "é", "字", "x", "\n", "A_b.c=d/e+f-g", "tok", "en="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert finder.spans(text) == brute(text), text


def test_added_kinds_and_redaction(spark):
    text = "é ghp_" + "a1B2" * 9 + " xoxb-1234567890ab -----BEGIN RSA PRIVATE KEY----- token = abcdefghijklmnop!"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 0), (3, "", 0), (3, "", 0), (4, "plain", 5)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r.spans for r in find_secrets(docs).collect()}
    assert [text[s.start : s.end] for s in rows[1]] == ["ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "token = abcdefghijklmnop"]
    assert rows[2] == rows[3] == rows[4] == []
    out = {r.doc_id: r for r in redact_secrets(docs).collect()}
    assert out[1].text == "é [github] [slack] [key] [assign]!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[4].text == "plain"
    assert len(RULES) == 6


def test_empty_table(spark):
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
