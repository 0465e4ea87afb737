"""Secret scan: derived trigram queries, the index against plain scans, the base rules by hand, odd rows."""

import random
import re

import numpy as np
import pytest

from bidlens.llm import secret_scan as s

from ..oracle import assert_same, connect
from .cases import empty_rows, odd_rows

SF = "/root/testdata/sf0.001"
# The base rules as the contract writes them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text: str | None) -> list[tuple[int, str, int]]:
    """All base spans without any index."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def test_query_equals_sql(spark):
    assert_same(connect(SF), s.op11_secret_scan(spark, SF), s.OP11_SQL)


def test_trigram_queries_are_derived_from_the_patterns():
    assert s.trigram_query("AKIA[A-Z0-9]+") == frozenset([frozenset([b"aki", b"kia"])])
    assert s.trigram_query("[0-9a-f]{16,}") is None and s.trigram_query("(abc|d)x*") is None and s.trigram_query("(abc)?") is None
    assert s.trigram_query("ab(c|d)e") == frozenset([frozenset([b"abc", b"bce"]), frozenset([b"abd", b"bde"])])
    assert s.trigram_query("a{4}") == frozenset([frozenset([b"aaa"])])
    assert s.trigram_query(r"foo\d+bar") == frozenset([frozenset([b"foo", b"bar"])])
    assign = s.trigram_query(s.BASE[0].pattern)
    assert frozenset([b"tok", b"oke", b"ken"]) in assign and frozenset([b"api", b"pik", b"ike", b"key"]) in assign and len(assign) == 6


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
def test_every_match_meets_its_rules_query(rule):
    """Random texts out of the rules' own pieces: whatever the pattern finds, the query lets through."""
    rng = random.Random(rule.kind)
    pieces = ["password", "PassWd", "Secret", "TOKEN", "api_key", "apiKey", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "ghp_", "a" * 40, "AIza", "xoxb-", "sk_live_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----END ", "://", "user", "@", "é", "ſ", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)]
    found = s.candidates(s.trigram_query(rule.pattern), len(texts), *s._trigrams(texts))
    hit = {i for i, t in enumerate(texts) if re.search(rule.pattern, t)}
    assert hit <= set(found.tolist()) and (hit or rule.kind in ("pem", "signed", "login"))


def test_postings_are_the_rows_that_hold_a_trigram():
    texts = ["", "ab", "abc", "ABCd", "xéy", "abcabc"]
    gram, end, rows = s._trigrams(texts)
    start = np.concatenate([[0], end[:-1]])
    got = {int(g).to_bytes(3, "big"): rows[a:b].tolist() for g, a, b in zip(gram, start, end, strict=True)}
    assert got[b"abc"] == [2, 3, 5] and got[b"bcd"] == [3] and got[b"cab"] == [5] and got["xé".encode()] == [4]
    assert b"cab" in got and b"dx\xc3" not in got  # no trigram runs from one text into the next


def test_base_spans_equal_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    pieces = ["token", "password", "api_key", "apikey", "SECRET", "passwd", " = ", "=", ": ", '"', "'", "abcdefghijkl", "short", "0a1b2c3d4e5f6a7b", "AKIA", "0123456789ABCDEF", "ſecret", "toKen", "né", "\n", " ", "ghp_" + "a1" * 18, "://u:secretpw@h"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(400)] + ["token=token=abcdefghijkl", "token=secret:abcdefghijkl", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["spans"]] for r in s.scan_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [x for x in got[i] if x[1] in ("assign", "access", "hex")] == plain(text), text
    assert sum(len(plain(t)) for t in texts) > 200


def test_services(spark):
    texts = ["x ghp_" + "A1b2" * 9, "key AIza" + "x" * 35, "xoxb-1234567890-ab", "sk_live_" + "Zy" * 10, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJlLXNpZ25hdHVyZQ", "-----BEGIN RSA PRIVATE KEY-----\nMIIE+/=\n-----END RSA PRIVATE KEY-----", "postgres://bob:hunter22@db", "ghp_short http://a:b/c"]
    got = [[x["kind"] for x in r["spans"]] for r in s.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["github"], ["google"], ["slack"], ["payment"], ["signed"], ["pem"], ["login"], []]


def test_a_stored_index_is_searched_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "my token = abcdefghijklmn"), (2, "nothing here"), (3, "number 555-0199")], "doc_id long, text string")
    s.index_texts(df).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert sum(len(r["spans"]) for r in s.search_index(index).collect()) == 1
    own = (s.Rule("phone", "[0-9]{3}-[0-9]{4}"),)
    assert [(r["doc_id"], r["spans"][0]["secret"]) for r in s.search_index(index, own).where("size(spans) > 0").collect()] == [(3, "555-0199")]


def test_odd_rows(spark):
    out = s.scan_secrets(odd_rows(spark, ["token=" + "a" * 12] * 2))
    got = [(r["doc_id"], len(r["spans"])) for r in out.collect()]
    assert len(got) == 11 and sum(n for i, n in got if i and i >= 100) == 2 and dict(got)[3] == 0 and dict(got)[6] > 0
    assert s.scan_secrets(empty_rows(spark)).count() == 0
