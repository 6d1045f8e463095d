import pytest
from pyspark.sql import functions as F

from tests.llm.common import documents, empty, frame, odd
from twinsift.llm import mixing


def filled(sizes, weights, cap=3):
    """Targets by sharing the excess again and again."""
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(target[s] for s in fixed)
        w = sum(weights[s] for s in sizes if s not in fixed)
        for s in sizes:
            if s not in fixed:
                target[s] = left * weights[s] / w
        over = {s for s in sizes if s not in fixed and target[s] > cap * sizes[s]}
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
        fixed |= over


def test_targets_and_words_taken(spark):
    rows = documents(300)
    rows += [(7000 + i, "few words here", "en", "tiny", 0) for i in range(4)] + [(8000, "null source words", "en", None, 0)]
    df = frame(spark, rows)
    out = mixing.mix(df).join(df.select("doc_id", "text", "source"), "doc_id").collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        assert r["size"] == len([w for w in (r["text"] or "").split() if w])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and mine[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], abs=max(4, 0.02 * want[s]))
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(want[s], rel=1e-4)


def test_rates_are_exponential_in_size(spark):
    import math

    out = mixing.mix(frame(spark, documents(200)), ("doc_id", "source")).filter("source_size > 0 and rate < 2.999").toPandas()
    for _, g in out.groupby("source"):
        lam = [math.log(r) / s for r, s in zip(g["rate"], g["size"], strict=True) if s]
        assert max(lam) - min(lam) < 1e-9


def test_reruns_agree_and_order_doesnt_matter(spark):
    df = frame(spark, documents(150))
    a = {tuple(r) for r in mixing.mix(df).collect()}
    assert a == {tuple(r) for r in mixing.mix(df.repartition(7)).collect()}


def test_a_hot_size_is_dealt_out(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    out = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("t"), F.max("copies").alias("c")).collect()
    for r in out:
        assert r["t"] == pytest.approx(r["target"], abs=3)


def test_odd_and_empty(spark):
    out = {r["doc_id"]: r for r in mixing.mix(odd(spark)).collect()}
    assert len(out) == 10 and out[5001]["size"] == 0 and out[5001]["taken"] == 0 and out[5007]["size"] == 30_000
    assert mixing.mix(odd(spark)).count() == 11
    assert mixing.mix(empty(spark)).count() == 0
    assert [tuple(r) for r in mixing.mix(frame(spark, [(1, " ", "en", "s", 1)])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]
