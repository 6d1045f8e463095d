import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from twinsift.llm import queries, whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=8):
    """n, deviations, eigenvalues, whitened by component, trace; whole numbers throughout the sums."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, deviations, values[order], centred @ vectors_[:, order] / np.sqrt(values[order]), sum(deviations) / n**3


def check(rows, vectors, k=8, tolerance=1e-8):
    n, deviations, values, whitened, trace = brute(vectors, k)
    assert len(rows) == n * k
    got = np.zeros((n, k))
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * sign).max() < tolerance
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-9 and np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query_against_whole_covariance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.op13_whitening(spark, SF).collect(), [r["embedding"] for r in rows])


def frame(spark, vectors, **more):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)


def test_many_dimensions_converge_before_the_basis_is_full(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 12)) * (2.0 ** -np.arange(12)) @ rng.standard_normal((12, 300)) * 10
    vectors = np.float32(vectors + rng.standard_normal((400, 300)) * 1e-2)
    rows = wh.quantised(frame(spark, vectors))
    model = wh.fit(rows)
    assert model.passes * wh.BLOCK < 300
    check(wh.digest(wh.whiten(rows)).collect(), vectors, tolerance=1e-6)


def test_breakdown_brings_fresh_directions(spark):
    rng = np.random.default_rng(5)  # rank 3 within 40 dimensions: the first product adds nothing new
    vectors = np.float32(rng.integers(-40, 40, (90, 3)) @ rng.integers(-3, 4, (3, 40)) / 64)
    rows = wh.whiten(wh.quantised(frame(spark, vectors)), block=2)
    assert {r["component"] for r in rows.collect()} == {1, 2, 3}
    check(rows.collect(), vectors, k=3)
    new = wh._orthogonal(np.zeros((5, 2)), np.eye(5)[:, :2], 1.0, np.random.default_rng(1), 2)
    assert np.abs(np.column_stack([np.eye(5)[:, :2], new]).T @ np.column_stack([np.eye(5)[:, :2], new]) - np.eye(4)).max() < 1e-12


def test_unusable_rows_go(spark):
    rng = np.random.default_rng(6)
    good = np.float32(rng.standard_normal((30, 9)))
    bad = [None, [None] * 9, [float("nan")] + [0.0] * 8, [float("inf")] + [0.0] * 8, [1.0, None] + [0.0] * 7]
    df = frame(spark, [*good, *bad]).withColumns({"x": F.lit("clash"), "w": F.lit(1), "a": F.lit(None).cast("int"), "component": F.lit(3)})
    check(wh.digest(wh.whiten(wh.quantised(df))).collect(), good)


def test_repeats_ties_and_ends(spark):
    rng = np.random.default_rng(8)
    vectors = np.float32(rng.standard_normal((20, 8)))
    df = spark.createDataFrame([(None if i == 3 else (1 << 62) + i, [float(c) for c in v], None) for i, v in enumerate(vectors) for _ in range(2)], SCHEMA)
    rows = wh.digest(wh.whiten(wh.quantised(df))).collect()
    assert len(rows) == 40 * 8 and {r["vec_id"] for r in rows} == {None, *((1 << 62) + i for i in range(20) if i != 3)}
    for flat in ([[0.5, 0.25]] * 7, [[1.0, 2.0, 3.0]], [], [[]], [[]] * 3):
        assert wh.whiten(wh.quantised(frame(spark, flat))).collect() == []
    few = [[1.0, 0.0], [0.0, 1.0], [3.0, 1.0], [0.5, 0.25]]
    check(wh.digest(wh.whiten(wh.quantised(frame(spark, few)))).collect(), few, k=2)
    with pytest.raises(ValueError, match="length"):
        wh.whiten(wh.quantised(frame(spark, [[1.0], [1.0, 2.0]])))


def test_sums_are_exact(spark):
    """Deviations beyond 53 bits, by whole numbers."""
    vectors = [[1e5 + i, -2e3 * i, 3.0 * i * i] for i in range(50)]
    rows = wh.whiten(wh.quantised(frame(spark, np.float32(vectors)))).collect()
    want = brute(np.float32(vectors))[1]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == dict(enumerate(want)) and max(want) > 1 << 60
