import random

import pytest

from bidlens.llm import decontamination
from bidlens.llm.decontamination import MOST_EDITS, drop_leaky, edit_distance_within, find_leaks, plain

from .cases import empty_rows, odd_rows


def semi_global(a, b):
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, 40))) for lo in (1, 1))
        found = edit_distance_within(a, b, 99)
        assert (found[0] if found else len(a)) == semi_global(a, b)


VOCABULARY = [a + b for a in ("re", "an", "tion", "the", "er", "ing", "st", "ou") for b in ("ha", "nd", "ble", "on", "es", "", "at", "ly")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edit(rng, text, rate):
    s = list(text)
    for _ in range(int(rate * len(text))):
        p, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.33:
            s[p] = rng.choice("abcdefgh")
        elif kind < 0.66:
            s.insert(p, rng.choice("abcdefgh"))
        else:
            del s[p]
    return "".join(s)


def edit_by(rng, text, rate, kind):
    s = list(text)
    for _ in range(int(rate * len(text))):
        p = rng.randrange(len(s))
        if kind == "delete":
            del s[p]
        else:
            s[p : p + (kind == "replace")] = rng.choice("abcdefgh")
    return "".join(s)


def short_sentence(rng, lo, hi):
    n, s = rng.randint(lo, hi), ""
    while len(s) < n:
        s = f"{s} {rng.choice(VOCABULARY)}".strip()
    return s


@pytest.mark.parametrize(("lo", "hi"), [(24, 44), (48, 76), (80, 116), (120, 350)])
@pytest.mark.parametrize("rate", [0.0, 0.1, MOST_EDITS])
def test_recall_against_all_pairs(spark, lo, hi, rate):
    """Every item against every document: what the exact distance accepts is found, and nothing else."""
    rng = random.Random(2)
    items = [(k, short_sentence(rng, lo, hi).capitalize() + ".") for k in range(40)]
    docs = [(i, sentence(rng, 20) + "\n" + edit(rng, items[i % 40][1], rate).upper() + "! " + sentence(rng, 20)) for i in range(120)]
    docs += [(1000 + i, sentence(rng, 60)) for i in range(40)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    want = {}
    for k, item in items:
        q = plain(item)
        for i, text in docs:
            hit = edit_distance_within(q, plain(text), int(MOST_EDITS * len(q)))
            if hit:
                want[i, k] = hit[0]
    assert len(want) >= 90 and set(got) <= set(want)
    assert len(got) >= (0.9 if rate else 1.0) * len(want)
    assert sum(got[p] == want[p] for p in got) >= 0.99 * len(got)


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_recall_of_each_kind_of_edit(spark, kind):
    """At the limit, in every class of item lengths: of what the exact distance accepts, nine in ten are found."""
    rng = random.Random(kind)
    ranges = [(24, 44), (48, 76), (80, 116), (120, 350)]
    items = [(100 * c + k, short_sentence(rng, *ranges[c]) + " " + sentence(rng, 0)) for c in range(4) for k in range(40)]
    docs = [(1000 * c + i, sentence(rng, 12) + "\n" + edit_by(rng, plain(items[40 * c + i % 40][1]).decode(), MOST_EDITS, kind) + "! " + sentence(rng, 12)) for c in range(4) for i in range(200)]
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    texts, shares = dict(docs), []
    for c in range(4):
        own = [(1000 * c + i, *items[40 * c + i % 40]) for i in range(200)]
        want = {(i, k) for i, k, item in own if edit_distance_within(plain(item), plain(texts[i]), int(MOST_EDITS * len(plain(item))))}
        shares.append(len(got & want) / len(want))
    assert min(shares) >= 0.9, shares



def test_short_items_and_texts_without_blanks(spark):
    long = "東京都は日本の首都であり世界最大級の都市圏を形成している経済の中心地である"
    items = spark.createDataFrame([(1, "Tiny one"), (2, long), (3, "短い文"), (4, "one")], "item_id long, text string")
    docs = [(1, "a tiny, one thing"), (2, "tinyone nones"), (3, "これは" + long[:20] + "大" + long[20:] + "と言われる"), (4, "それは短い文です"), (5, "tiny"), (6, "one")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == {(1, 1): 0, (1, 4): 0, (3, 2): 3, (4, 3): 0, (6, 4): 0}


def test_several_passes_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = spark.createDataFrame([(k, short_sentence(rng, 10, 90)) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, sentence(rng, 10) + " " + r["text"] + " " + sentence(rng, 10)) for i, r in enumerate(items.collect())], "doc_id long, text string")
    one = sorted(map(tuple, find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 9)
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == one and len(one) >= 30


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (None, "x" * 50), (3, "tiny"), (9, "!!"), (1, "one two three four five six seven")], "item_id long, text string")
    found = find_leaks(odd_rows(spark), items)
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 1, 2]
    kept = drop_leaky(odd_rows(spark), items)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 5, 6, 7] and kept.columns == odd_rows(spark).columns
    assert find_leaks(empty_rows(spark), items).count() == 0
    assert find_leaks(odd_rows(spark), items.where("false")).count() == 0
