import hashlib
import re

from octaray.llm.secrets import RULES, BASE_RULES, find_secrets, redact_secrets, secret_digest, trigram_postings, trigram_query

TEXTS = [
    None, "", "nothing here", 'Password = "abc" token:xyz123 API_KEY= k/ey+=.-_ secret:short', "token=token=abcdef secret=token:abcdefg",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAAKIA" + "C" * 20, "a" * 23 + " " + "0f" * 12 + "G" + "ab" * 40, "é中 token = 0123456789abcdef0123456789abcdef",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20 + " xoxb-1234567890-ab", "x\x01token:abcdef\x01 " + "deadbeef" * 4, "p " * 40_000 + "passwd:verylongone " + "é" * 40_000 + "secret=another1",
]


def spans_by_hand(text, rule):
    for m in re.finditer(rule.pattern, text or ""):
        if len(m.group(rule.group)) >= rule.least:
            yield m.start(), RULES.index(rule), m.end(), rule.kind


def test_spans_equal_a_full_scan(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secret_digest(find_secrets(df)).collect()}
    for i, t in enumerate(TEXTS):
        every = sorted(s for r in RULES for s in spans_by_hand(t, r))
        base = [s for s in every if s[1] < len(BASE_RULES)]
        said = [",".join(f"{k}:{s}:{e}" for s, _, e, k in x) for x in (every, base)]
        assert got[i]["spans"] == said[0] and got[i]["base_sha256"] == hashlib.sha256(said[1].encode()).hexdigest(), t
        assert [got[i][f"n_{r.kind}"] for r in BASE_RULES] == [sum(s[3] == r.kind for s in base) for r in BASE_RULES]
    assert secret_digest(find_secrets(df.limit(0))).count() == 0


def test_queries_hold_for_every_match(spark):
    """No match lacks the trigrams that its rule's query asks for, and rules without any have an empty one."""
    by = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert by["hex"] == [frozenset()] and by["access"] == [frozenset({"aki", "kia"})]
    for t in TEXTS:
        for r in RULES:
            for start, _, end, _ in spans_by_hand(t, r):
                low = t[start:end].lower()
                assert any(all(g in low for g in q) for q in by[r.kind])
    df = spark.createDataFrame([(1, "AKIA")], "doc_id long, text string")
    assert sorted(map(tuple, trigram_postings(df).collect())) == [("aki", 1), ("kia", 1)]


def test_redaction_leaves_nothing(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    out = redact_secrets(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == TEXTS[2]
    assert all(not list(spans_by_hand(t, r)) for t in rows.values() for r in BASE_RULES)


def test_shortest_access_keys(spark):
    """Texts whose only secret is an access key of 19 to 24 characters: ``least`` counts the whole match."""
    keys = ["AKIA" + "IOSFODNN7EXAMPLE7890"[:n] for n in range(15, 21)]
    df = spark.createDataFrame([(i, f"the key {k} leaked") for i, k in enumerate(keys)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_access"], r["spans"]) for r in secret_digest(find_secrets(df)).collect()}
    masked = {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()}
    assert found[0] == (0, "") and masked[0] == f"the key {keys[0]} leaked"
    for i, k in enumerate(keys[1:], 1):
        assert found[i] == (1, f"access:8:{8 + len(k)}") and masked[i] == "the key <access removed> leaked"
