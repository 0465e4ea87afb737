import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidlens.llm import packing
from bidlens.llm.packing import best_fit, pack, plan, reduce_instance
from bidlens.llm.token_counts import PrefixCounter, PrefixTable, count_tokens, cut_at, load, longest_within, packed_steps, tokens_at, unpacked_counts

from .cases import empty_rows, odd_rows

ODD = ["각하 각ㄱ ก็ไม่ที่ नमस्ते", "--'s '' 're'x <|endoftext|>x<|endo a\xa0b we'r", "It's don't <|endoftext|> we'll", "éa ́b ÀÉ ß İx 'S 12ab #$% naïve", "a" * 50 + " the" * 3, "x\x1cy \x85 z q", " ﬁ ŒÄ", "日本語 テキスト 123"]


shared_counter = lru_cache(maxsize=1)(PrefixCounter)


@pytest.fixture(scope="module")
def counter():
    return shared_counter()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeéthe' \n1<|>endofxß\x1cć.,ЖÀ\u0327\u0301각\u1100\u1161\u11a8\xa0\u2003ÅΣσςİ", max_size=40))
def test_every_prefix_has_the_library_count(text):
    counter = shared_counter()
    want = [len(e.ids) for e in counter.tokenizer.encode_batch_fast([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
    assert counter(text).tolist() == want


def test_odd_prefixes(counter):
    for text in ODD:
        want = [len(e.ids) for e in counter.tokenizer.encode_batch_fast([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert counter(text).tolist() == want


def test_tokens_that_stay_apart_and_whole_tokens(counter):
    """The rules on merges against encoding the text itself."""
    rng, table = random.Random(3), counter.table
    model, ids = counter.tokenizer.model, counter.tokenizer.get_vocab()
    tokens = sorted(table.inside)
    for _ in range(4000):
        x, y = rng.choice(tokens), rng.choice(tokens)
        joint = [ids[x], ids[y + "</w>"]] if y in table.final else None
        if joint:
            assert table.apart(x, y + "</w>") == ([t.id for t in model.tokenize(x + y)] == joint)
    whole = {t[:-4]: table.whole(t) for t in ids if t.endswith("</w>")}
    assert all(ok == ([t.id for t in model.tokenize(w)] == [ids[w + "</w>"]]) for w, ok in whole.items())
    assert isinstance(table, PrefixTable)


def test_steps_of_any_size_come_back():
    for steps in ([], [1, 0, -1], [127, -128], [128], [1, -40_000, 7]):
        assert unpacked_counts(packed_steps(np.array(steps, "<i4"))).tolist() == [0, *np.cumsum(steps).astype(int).tolist()]


def test_budget(counter):
    text = "the quick brown foxes jumped overzealously"
    for budget in range(0, 12):
        n = longest_within(counter(text), budget)
        assert all(c <= budget for c in counter(text)[: n + 1]) and (n == len(text) or counter(text)[n + 1] > budget)


def test_counts_equal_the_library(spark):
    rows = odd_rows(spark, ODD)
    t = load()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    counted = count_tokens(rows, limit=3)
    got = counted.select("doc_id", "n_tokens", "over_limit", "n_bytes", "fits", "prefix_steps", cut_at(3).alias("cut"), cut_at(0).alias("none"), tokens_at(9).alias("nine")).collect()
    assert len(got) == 9 + len(ODD)
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 3, len(text.encode()))
        assert r["fits"] == r["cut"] and len(t.encode(text[: r["cut"]], add_special_tokens=False).ids) <= 3
        assert unpacked_counts(bytes(r["prefix_steps"])).tolist() == shared_counter()(text).tolist() and r["nine"] == len(t.encode(text[:9], add_special_tokens=False).ids)
        assert r["none"] == 0 or not text[: r["none"]].strip()
    assert count_tokens(empty_rows(spark)).count() == 0


def exact(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            j = bins.index(room)
            bins[j] += items[i]
            place(i + 1, bins)
            bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_best_fit_is_whole():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(max(1, capacity // 8), capacity) for _ in range(rng.randint(1, 10))]
        counts = {w: items.count(w) for w in set(items)}
        fixed, rest = reduce_instance(counts, capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + exact(left, capacity) == exact(items, capacity)
        placed = {}
        for times, lengths in [*fixed, *best_fit(rest, capacity)]:
            assert sum(lengths) <= capacity
            for w in lengths:
                placed[w] = placed.get(w, 0) + times
        assert placed == counts


def test_plan_is_bounded_by_lengths_not_by_items():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 2048)
    few = {int(w): int(n) for w, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    many = {w: n * 1_000_000 for w, n in few.items()}
    assert sum(len(r[0]) for r in plan(many).values()) < 40_000


def test_bins_of_three_are_fixed_at_once():
    for n in (1, 1_000, 1_000_000):
        fixed, rest = reduce_instance({900: n, 620: n, 520: n})
        assert [(times, sorted(lengths)) for times, lengths in fixed] == [(n, [520, 620, 900])] and not rest
        assert sum(len(r[0]) for r in plan({900: n, 620: n, 520: n}).values()) == 3


def test_reduction_one_by_one_gives_as_few_bins():
    """Fixing equal bins at once against the exact optimum, with many items of few lengths."""
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([12, 20, 31])
        lengths = rng.sample(range(3, capacity), 3)
        counts = {w: rng.randint(1, 4) for w in lengths}
        fixed, rest = reduce_instance(counts, capacity)
        items = [w for w, n in counts.items() for _ in range(n)]
        left = [w for w, n in rest.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + exact(left, capacity) == exact(items, capacity)


@pytest.mark.parametrize("group", [1, 3, 100_000])
def test_pack_equals_a_check_by_hand(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = odd_rows(spark, ODD)
    t = load()
    got = pack(rows, capacity=16).collect()
    want = []
    for r in rows.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 16):
            part = ids[k : k + 16]
            want.append((r["doc_id"], k // 16, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 16) * 1.1 + 2
    assert pack(empty_rows(spark)).count() == 0
