"""Hard negatives against SQL and plain search; the bounds hold; blocks and tiles do not matter; odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.llm import hard_negatives as h

from ..oracle import assert_same, connect
from .cases import CLASHING

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, negatives=5, share=80):
    """The same by scoring every row for every anchor."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in kept if is_anchor(i)}:
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, w, k in kept if j != i and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in others if x[2] == c)[:positives]:
            found = sorted((s, j) for s, j, k in others if k != c and share * -ps <= 100 * -s <= 100 * -ps)[:negatives]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, sf):
    assert_same(connect(f"/root/testdata/{sf}"), h.op13_hard_negatives(spark, f"/root/testdata/{sf}"), h.OP13_SQL)


@pytest.mark.parametrize(("d", "near"), [(5, 0.1), (64, 0.3), (100, 0.05), (130, 1.0)])
def test_bounds_always_hold_and_narrow(d, near):
    rng = np.random.default_rng(d)
    centre = rng.standard_normal(d)
    v = np.floor(256 * (centre + near * rng.standard_normal((400, d)))).astype(np.int64)
    v[0] = 0
    v[1] = v[2]
    code, align, norm = h.encode(v, h.rotation(d))
    a = h.Anchors(np.arange(50), np.arange(50), np.zeros(50), v[:50])
    low, high = h.bounds(a, slice(0, 50), code, align, norm)
    true = v[:50] @ v.T
    assert (low <= true).all() and (true <= high).all()
    most = np.linalg.norm(v[:50], axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    assert (high - low)[1:, 1:].mean() < 0.8 * (2 * most)[1:, 1:].mean()  # narrower than the lengths alone tell
    turn = h.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d))


def test_equals_plain_search_with_ties(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.choice([0, 0, 0.01]) for x in rng.choice(base)], rng.randrange(3)) for i in range(500)]
    got = sorted(map(tuple, h.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_small_blocks_and_tiles_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [abs(rng.gauss(0.1, 0.2)) for _ in range(8)], rng.randrange(2)) for i in range(300)]
    want = plain(rows, lambda i: i % 7 == 0, 3, 4, 50)
    monkeypatch.setattr(h, "ANCHORS", 10)
    got = h.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0, positives=3, negatives=4, low_share=50)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.45], 2), (2, [0.5, 0.45], 2), (None, [0.5, 0.5], 1), (3, None, 1), (4, [0.5, None], 1), (5, [nan, 0.5], 2), (6, [inf, 0.5], 2), (7, [0.5, 0.5], None), (8, [], 2), (9, [0.5], 2), (10, [0.5, 0.5, 0.5], 1), (0, [0.5, 0.5], 1), (0, [0.5, 0.4], 1), (11, [-1.0, -1.0], 1), (12, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'mine' AS `{c}`" for c in [*CLASHING, "id", "v", "code", "x", "anchor"]])
    got = sorted(map(tuple, h.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and {r[0] for r in got} == {0}
    assert h.mine_hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert h.mine_hard_negatives(df, F.lit(False)).count() == 0
