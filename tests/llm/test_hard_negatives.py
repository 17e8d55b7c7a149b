import math
import random

import numpy as np
import pytest

import __spark_entry__ as contract
from threadline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score int, block int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA)


def mined_by_hand(rows, positives=5, negatives=10):
    kept = []
    for i, v, y in rows:
        if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    last = lambda i: (i is None, i or 0)
    found = []
    for a, (anchor, z, y) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(z, x)), last(i), i, label) for b, (i, x, label) in enumerate(kept) if b != a]  # noqa: B905
        scored.sort(key=lambda s: s[:2])
        for p, _, positive, _ in [s for s in scored if s[3] == y][:positives]:
            inside = [s for s in scored if s[3] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            found += [(anchor, positive, k, s[2], -p, -s[0]) for k, s in enumerate(inside, 1)]
    return sorted(found, key=repr)


def mined(spark, rows):
    frame = frame_of(spark, rows)
    found = hn.mine(frame, frame["vec_id"] % 100 == 0).collect()
    return sorted((tuple(r) for r in found), key=repr)


def vectors(n=900, seed=1, near=0.5):
    """Half of the anchors are near copies of one vector, so that bounds bite."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=16)
    rows = []
    for i in range(n):
        v = base + 0.01 * rng.normal(size=16) if rng.random() < near else rng.normal(size=16)
        rows.append((i * 5, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    return rows


def test_against_all_scores(spark, monkeypatch):
    rows = vectors()
    expected = mined_by_hand(rows)
    assert len(expected) > 500
    assert mined(spark, rows) == expected
    monkeypatch.setattr(hn, "TREE", 7)  # many trees and blocks
    monkeypatch.setattr(hn, "BLOCK", 50)
    assert mined(spark, rows) == expected


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 24)) * 200
    anchors = np.floor(np.concatenate([base[i % 4] + rng.normal(size=24) for i in range(32)]).reshape(32, 24))
    rows = np.floor(rng.normal(size=(500, 24)) * 200)
    order, parents, lengths = hn.span(anchors)
    place = np.empty(32, int)
    place[order] = np.arange(32)
    parents = np.where(parents[order] < 0, -1, place[parents[order]])
    assert (parents[1:] < np.arange(1, 32)).all() and parents[0] == -1

    class Side:
        def __init__(self, v):
            self.vectors, self.exact, self.norms = v, None, np.sqrt((v**2).sum(axis=1))
            self.ids = self.rows = np.arange(len(v))
            self.labels = np.zeros(len(v), int)

    climb = hn.Climb(Side(rows), Side(anchors[order]), parents, lengths[order])
    true = rows @ anchors[order].T
    for i in range(32):
        low, high = climb.bound(i)
        assert (low <= true[:, i]).all() and (true[:, i] <= high).all()
        needed = np.flatnonzero((high >= 60_000) & (low <= 1e9))
        assert (climb.exact(i, needed) == true[needed, i]).all()
        assert set(np.flatnonzero(true[:, i] >= 60_000)) <= set(needed)
    assert climb.rescored < 0.5 * 32 * 500


def test_odd_rows(spark):
    rows = vectors(300, 5)
    rows += [(None, [0.5] * 16, 1), (None, [0.5] * 16, 2), (100, rows[20][1], rows[20][2]), (100, rows[20][1], rows[20][2])]
    rows += [(200, None, 1), (300, [0.1] * 16, None), (400, [0.1, None], 1), (7, [float("nan")] * 16, 1), (9, [float("inf")] + [0.0] * 15, 2)]
    rows += [(1100, [0.25] * 3, 1), (11, [], 2), (1300, [], 0), (12, [0.5] * 40, 3)]
    assert mined(spark, rows) == mined_by_hand(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(100, [0.5], 1)]) == []


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i * 50, [rng.uniform(-1, 1) * 3e5 for _ in range(4)], i % 3) for i in range(40)]
    assert mined(spark, rows) == mined_by_hand(rows)
    huge = [(i * 50, [1e30, float(i)], i % 3) for i in range(9)]  # beyond longs: defined, not exact
    assert len(mined(spark, huge)) >= 0


def test_query(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in frame]
    found = contract.queries()["op13_hard_negatives"](spark, data)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == mined_by_hand(rows)


@pytest.mark.parametrize("score", [-7, 0, 1, 99, 100, 101, 12345])
def test_window(score):
    low, high = hn.window(score)
    assert [n for n in range(-200, 12400) if 30 * score <= 100 * n <= 90 * score] == list(range(max(low, -200), min(high, 12399) + 1))
