import hashlib
import random
from collections import Counter

import numpy as np

from bidlens.llm.fingerprint import GEAR, LEAST, MOST, NORMAL, boundaries, chunks, fingerprints, gear_hash, likeness, packed, unpacked

from .cases import empty_rows, odd_rows


def test_gear_hash_equals_its_definition():
    rng = random.Random(1)
    for n in (0, 1, 5, 31, 33, 100, 1000):
        data, h, want = bytes(rng.randrange(256) for _ in range(n)), 0, []
        for b in data:
            h = (2 * h + int(GEAR[b])) % 2**32
            want.append(h)
        assert gear_hash(np.frombuffer(data, np.uint8)).tolist() == want


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh  éü") for _ in range(4000))
    ends = boundaries(text.encode())
    assert ends[-1] == len(text.encode()) and all(b - a <= MOST for a, b in zip([0, *ends], ends, strict=False))
    whole = chunks(text)
    assert unpacked(packed(whole)) == dict(whole)
    assert likeness(whole, chunks("xx" + text)) > 0.9
    assert likeness(whole, whole) == 1.0 and likeness({}, {}) == 1.0 and likeness(whole, {}) == 0.0


def plain_boundaries(data):
    """The same rule a byte at a time: a laxer end from the normal size on, a stricter one before, none below the least size."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(GEAR[b])) % 2**32
        size = i + 1 - start
        if size == MOST or (size >= NORMAL and h >> 28 == 0) or (LEAST <= size <= NORMAL and h >> 24 == 0):
            out.append(i + 1)
            start = i + 1
    return out if start == len(data) else [*out, len(data)]


def test_boundaries_equal_the_plain_rule():
    rng = random.Random(7)
    for _ in range(300):
        n, letters = rng.choice([0, 1, 23, 24, 25, 64, 300, 3000]), rng.choice(["ab", "abcdefgh ", "é日x "])
        data = "".join(rng.choice(letters) for _ in range(n)).encode()
        assert boundaries(data) == plain_boundaries(data)


def test_likeness_equals_shared_weight():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ({bytes([k]): rng.randint(1, 9) for k in rng.sample(range(12), rng.randint(1, 9))} for _ in range(2))
        bag = lambda x: Counter(k for k, w in x.items() for _ in range(w))
        shared = sum((bag(a) & bag(b)).values())
        assert likeness(a, b) == shared / min(sum(a.values()), sum(b.values())) == likeness(b, a)


def test_next_and_edited_texts(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, "".join(rng.choice("abc def") for _ in range(rng.randint(0, 300)))) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ordered = sorted(rows)
    for parts in (1, 5, 40):
        got = {r["doc_id"]: r for r in fingerprints(df, parts=parts).collect()}
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(ordered):
            other = ordered[(k + 1) % len(ordered)][1]
            half = len(text) // 2
            new = text[: len(text) - half] + other[:half]
            assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert got[i]["fingerprint"] == packed(chunks(text)) and got[i]["near_next"] == likeness(chunks(text), chunks(other))


def test_odd_rows(spark):
    rows = fingerprints(odd_rows(spark)).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert fingerprints(empty_rows(spark)).count() == 0
