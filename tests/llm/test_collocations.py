"""Collocations against SQL on a table and against plain counting on small texts; exact arithmetic; odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidlens.llm import collocations as c

from ..oracle import assert_same, connect
from .cases import empty_rows, odd_rows

SF = "/root/testdata/sf0.001"


def plain(rows, least, longest):
    """The same by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if a >= least and len(p[1]) >= 2}
    out = set()
    for (lang, p), a in kept.items():
        if any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in kept.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.add((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return out


def test_query_equals_sql(spark):
    assert_same(connect("/root/testdata/sf0.01"), c.op12_phrase_collocations(spark, "/root/testdata/sf0.01"), c.OP12_SQL)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "x\x00y", "é", "É", " ", "new", "york", "\u0085", "ſ", "b" * 50]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", "\r\n"]
    texts = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    texts += [("en", "new york city hall opens " * 4), ("en", None), ("en", ""), ("de", "a a a a a a a a")] * 3
    df = spark.createDataFrame(texts, "lang string, text string").repartition(7)
    got = {tuple(r) for r in c.collocations(df, least=5).collect()}
    want = plain(texts, 5, 5)
    assert got == want and len(want) > 100
    assert {tuple(r) for r in c.collocations(df, least=3, longest=3).collect()} == plain(texts, 3, 3)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    texts = [("en", " ".join(rng.choices("abcdefghij", k=30))) for _ in range(50)]
    monkeypatch.setattr(c, "BITS_EACH", 0)  # the smallest bitmap
    df = spark.createDataFrame(texts, "lang string, text string")
    assert {tuple(r) for r in c.collocations(df, least=4).collect()} == plain(texts, 4, 5)


def test_products_beyond_64_bits(spark, monkeypatch):
    a, l, r, n = 3_000_000_007, 5_000_000_029, 7_000_000_001, 9_000_000_000_000_011
    counts = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, k int, phrase string, f long")
    monkeypatch.setattr(c, "_counted", lambda *_: (counts, spark.createDataFrame([("en", n)], "lang string, n long")))
    assert c.collocations(counts, lang_col="lang", text_col="phrase").first()["score"] == 1000 * a * n // (l * r)


def test_first_of_a_language(spark):
    rows = [("en" if i % 3 else "de", f"p{i:04}", i % 7, 1, 1, 1, i % 11) for i in range(3000)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r["lang"], r["rank"], r["phrase"]) for r in c.top_collocations(found, 50).orderBy("lang", "rank").collect()]
    want = []
    for lang in ("de", "en"):
        mine = sorted((-r[6], -r[2], r[1]) for r in rows if r[0] == lang)[:50]
        want += [(lang, i + 1, x[2]) for i, x in enumerate(mine)]
    assert got == want


def test_streams_are_merged_without_hash_tables(spark):
    df = spark.createDataFrame([("en", "a b c a b c d")] * 3, "lang string, text string")
    plan = c.collocations(df, least=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "ShuffledHashJoin" not in plan


def test_odd_rows(spark):
    out = {(r["lang"], r["phrase"]): r["a"] for r in c.collocations(odd_rows(spark), least=2).collect()}
    assert out["en", "one two three four five"] == 4 and out["en", "and more"] == 20_000 - 0
    assert c.collocations(empty_rows(spark)).count() == 0
    assert c.top_collocations(c.collocations(empty_rows(spark).withColumn("text", F.lit("a b")))).count() == 0
