import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """rows: id, label, whole numbers."""
    out = []
    for a, la, x in rows:
        if a % every:
            continue
        scored = [(-sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), b, lb) for b, lb, y in rows if b != a]
        for ps, p, _ in sorted(t for t in scored if t[2] == la)[:positives]:
            fit = sorted(t for t in scored if t[2] != la and 50 * -ps <= 100 * -t[0] <= 95 * -ps)[:negatives]
            out += [(a, p, k, b, -ps, -s) for k, (s, b, _) in enumerate(fit, 1)]
    return sorted(out)


def quantised(rows):
    return [(i, la, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, la in rows]


def vectors(n=400, d=24, seed=0, labels=4):
    """Clusters, ties by copies, and vectors shorter than others."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, d)) * 0.7
    x[::9] = x[3]
    x[5::31] *= 0.05
    x[7] = 0
    return [(i, [float(c) for c in np.float32(v / 4)], int(rng.integers(0, labels) if i % 3 else 0)) for i, v in enumerate(x)]


def mined(spark, rows, every=50):
    df = hn.quantised(spark.createDataFrame(rows, SCHEMA))
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hn.mine(df, F.col("vec_id") % every == 0).collect())


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors()
    want = brute(quantised(rows), 8)
    assert len(want) > 300
    assert mined(spark, rows, 8) == want
    monkeypatch.setattr(hn, "GROUP_LEAST", 90)
    monkeypatch.setattr(hn, "SHARE_ANCHORS", 20)
    assert mined(spark, rows, 8) == want


def test_tiles_and_stages_lose_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (300, 32)) * (2.0 ** -np.arange(32) * 20).clip(0.2).round(2)
    x = np.floor(x).astype(np.int64)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    scores = x[:40] @ x.T
    for sparse in (0.0, 1.1):
        monkeypatch.setattr(hn, "SPARSE", sparse)
        for share in (0.5, 0.9, 0.99):
            need = np.quantile(scores, share, axis=1).astype(np.int64)
            most = scores.max(axis=1) - 5
            i, j, s = hn.survivors(hn.Side(x[:40], axes), hn.Side(x, axes), need, most, hn.slack_of(axes))
            want = (scores >= need[:, None]) & (scores <= most[:, None])
            assert sorted(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == [(a, b, int(scores[a, b])) for a, b in zip(*np.nonzero(want), strict=True)]


def test_most_pairs_are_left_out_early():
    rng = np.random.default_rng(9)
    x = np.floor(rng.standard_normal((2000, 64)) * 2.0 ** -(np.arange(64) / 6) * 256).astype(np.int64)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    a, r = hn.Side(x[:50], axes), hn.Side(x, axes)
    need = np.sort(x[:50] @ x.T, axis=1)[:, -6]
    first = a.stops[0]
    bound = a.rotated[:, :first] @ r.rotated[:, :first].T + a.rest[first][:, None] * r.rest[first]
    assert (bound >= need[:, None]).mean() < 0.05


def test_windows_are_whole_scores():
    for p in (*range(-40, 250), 10**12 + 7):
        low, high = hn.window_of(np.array([p]), 50, 95)
        got = range(int(low[0]), int(high[0]) + 1)
        near = range(p - 130, p + 130) if p < 1000 else [int(low[0]) - 1, int(low[0]), int(high[0]), int(high[0]) + 1]
        assert [s for s in near if s in got] == [s for s in near if 50 * p <= 100 * s <= 95 * p]


def test_odd_rows(spark):
    good = vectors(120, 6, 3)
    bad = [(1000, None, 1), (1050, [0.1] * 6, None), (1100, [None] + [0.1] * 5, 2), (1150, [float("nan")] + [0.1] * 5, 0), (1200, [float("-inf")] + [0.1] * 5, 0), (None, [0.1] * 6, 0)]
    again = good[10:30]
    df = spark.createDataFrame([*good, *again, *bad], SCHEMA).withColumns({"x": F.lit("clash"), "share": F.lit(1), "group": F.lit(2), "told": F.lit(None).cast("int")})
    got = hn.mine(hn.quantised(df), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == brute(quantised(good))


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2), (3, [0.9, 3.0], 3), (4, [0.2, 0.0], 3)]
    assert [r[:4] for r in mined(spark, rows)] == [(0, 1, 1, 2), (0, 1, 2, 3)]
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="length"):
        mined(spark, [(0, [1.0], 1), (1, [1.0, 0.5], 1)])
