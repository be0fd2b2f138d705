import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import secretscan
from treeline.llm.queries import op4_secret_spans
from treeline.llm.secretscan import BASE, MORE, Scanner, Segment, scan, trigram_query, trigrams_of

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == c for _, k, _ in found) for c in range(3)), hashlib.sha256(said.encode()).hexdigest())


def test_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = op4_secret_spans(spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(docs[r.doc_id])


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "paſſword=abcdefgh TOKEN : 'abc-def' toKen=abc"), (4, "x " * 90000 + "AKIA" + "A1" * 8), (4, "secret=aaaaaa"), (4, "secret=aaaaaa"), (None, "é😀api_key=" + "0123456789abcdef" * 2)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in scan(spark, docs).collect())
    assert got == sorted((str(a), *brute(b)) for a, b in rows)
    assert scan(spark, docs.limit(0)).count() == 0


def test_derived_queries():
    by_kind = {r.kind: trigram_query(r) for r in BASE + MORE}
    assert by_kind["hex"] is None
    assert trigrams_of(by_kind["access"]) == {"aki", "kia"}
    assert {"pas", "sec", "tok", "api"} <= trigrams_of(by_kind["assign"])


WORDS = st.sampled_from(["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\n", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "https://", "a:b@c.d"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12).map("".join), max_size=4))
def test_index_never_loses_a_match(texts):
    own = Scanner()
    segment = Segment(texts, own.table, len(own.number))
    for rule, query, compiled in zip(own.rules, own.queries, own.compiled):
        passed = segment.answer(query, own.number)
        assert all(passed[i] for i, t in enumerate(texts) if compiled.search(t))
    assert [[sum(k == c for _, k, _ in f) for c in range(3)] for f in own.scan(texts)] == [list(brute(t)[:3]) for t in texts]


def test_other_rules_add_spans(spark):
    docs = spark.createDataFrame([(1, "ghp_abcdefghijklmnop1234 and https://me:pw@host.org")], "doc_id long, text string")
    assert scan(spark, docs).first().spans == "prefixed:0:24,url_login:29:51"
    assert secretscan.Rule("x", "a+").spans(re.compile("a+"), "aa b a") == [(0, 2), (5, 6)]


#: The further kinds as plain patterns, tried at every place.
PLAIN = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "web_token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "prefixed": r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|rk_live_|glpat-)[A-Za-z0-9_-]{16,}",
    "url_login": r"[a-z]+://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+",
}
PARTS = st.sampled_from(["eyJ", "abcdefgh", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef01234567", ".", "_", "-", "ghp_", "glpat-", "http", "://", ":", "@", "/", " ", "\n", "host.org", "é", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "password", "=", "AKIA"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=16).map("".join), max_size=4))
def test_spans_of_all_kinds_against_brute_force(texts):
    own = Scanner()
    names = [r.kind for r in own.rules]
    for text, got in zip(texts, own.scan(texts)):
        kinds = ("assign", "access", "hex")
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        for kind, pattern in PLAIN.items():
            want += [(m.start(), names.index(kind), m.end()) for m in re.finditer(pattern, text, re.ASCII)]
        assert names[:3] == list(kinds) and got == sorted(want)


def test_long_texts_take_time_in_proportion():
    n = 1_000_000
    texts = [x * (n // len(x)) for x in ("a", "eyJ", "eyJabcdefgh.", "-----BEGIN ", "A", "PRIVATE KEY", "password ", "password=", "a:", "a://", "AKIA", "0", "ghp_", "x@y:z")]
    texts += ["a://" + "b" * n, "http://" + "a:b" * (n // 3), "-----BEGIN " + "A " * (n // 2), "password" + " " * n, "eyJ" + "a" * n, "a" * n + "://b:c@d"]
    own = Scanner()
    for text in texts:
        began = time.perf_counter()
        own.scan([text + " eyJ :// ghp_ AKIA secret -----BEGIN PRIVATE KEY"])
        assert time.perf_counter() - began < 3
