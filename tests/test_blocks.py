"""Pairs in blocks against plain Python, at block sizes that cut every group."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.operators import blocking, blocks, graph, matchers


def best_match(x, y):
    one = sum(min((p ^ q).bit_count() for q in y) for p in x) / len(x)
    return (one + sum(min((p ^ q).bit_count() for p in x) for q in y) / len(y)) / 2


def equal_bits(x, y):
    n = min(len(x), len(y))
    return 1 - sum((p ^ q).bit_count() for p, q in zip(x, y)) / (8 * n) if n else 0.0


def allowed(rows, tolerance=3):
    centres = {b for _, b, _ in rows}
    meet = lambda p, q: any(abs(p - c) <= tolerance and abs(q - c) <= tolerance for c in centres)
    return {(min(i, j), max(i, j)): (x, y) for i, p, x in rows for j, q, y in rows if i < j and meet(p, q)}


def signed(u):
    return u - (1 << 64) if u >> 63 else u


def sequences(n=90, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hashes = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 16]))]
        if rows and i % 3 == 0:  # near, or equal, to an earlier one
            hashes = [h ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 4, 12]))) for h in rng.choice(rows)[2]]
        rows.append((i, rng.choice([10, 10, 10, 12, 15, 16, 22, 40]), [h & (2**64 - 1) for h in hashes]))
    return rows


def pairs_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] if len(r) > 2 else None for r in rows}


@pytest.mark.parametrize("size", [3, 1000])
def test_sequences(spark, size):
    rows = sequences()
    df = spark.createDataFrame([(i, b, [signed(h) for h in x]) for i, b, x in rows], "id long, bucket int, value array<long>")
    want = {k: best_match(x, y) for k, (x, y) in allowed(rows).items()}
    assert set(pairs_of(blocking.duration_window_pairs(df, size=size))) == set(want)
    met = blocking.window_blocks(df, "value", size=size)
    assert pairs_of(blocks.scored(met, blocks.best_match())) == pytest.approx(want)
    assert pairs_of(blocks.scored(met, blocks.best_match(12))) == pytest.approx({k: s for k, s in want.items() if s <= 12})


@pytest.mark.parametrize("lengths", [[16], [1, 2, 5, 16], [3], [20, 40]])
def test_tiles_are_exact(lengths):
    rng = np.random.default_rng(6)
    left, right = ([rng.integers(-(1 << 63), (1 << 63) - 1, rng.choice(lengths), np.int64) for _ in range(n)] for n in (37, 301))
    right[5], right[7], left[0], left[1], right[300] = left[3], np.array([-1] * 4), np.array([0, -1]), np.array([-1]), left[4]
    for n in (1, 2, 301):
        found = {}
        for s, c, score in blocks.best_match_tiles(left, right[:n]):
            found |= {(s + i, c + j): score[i, j] for i in range(score.shape[0]) for j in range(score.shape[1])}
        plain = lambda x: [int(h) & (2**64 - 1) for h in x]
        some = [(i, j) for i in range(37) for j in range(n) if i < 6 or j in (0, 5, 7, 300)]
        assert len(found) == 37 * n
        assert all(found[i, j] == best_match(plain(left[i]), plain(right[j])) for i, j in some)


def test_distances_and_closest_without_pairs_as_rows(spark):
    rows = sequences(90, 7)
    rows += [(200 + i, 10, rows[4][2]) for i in range(12)] + [(300, 400, [7]), (301, 400, [7]), (302, 400, [9])]
    df = spark.createDataFrame([(i, float(b), [signed(h) for h in x]) for i, b, x in rows], "id long, duration double, phashes array<long>")
    files = df.withColumns({"media_type": F.lit("video"), "status": F.lit("done")})
    want = {k: best_match(x, y) for k, (x, y) in allowed(rows).items()}
    counts = {r["distance"]: r["n"] for r in matchers.perceptual_distances(files, None).collect()}
    assert counts == Counter(round(s) for s in want.values())
    nearest = [tuple(r) for r in matchers.closest_perceptual(files, None, 80).collect()]
    assert nearest == sorted(((*k, s) for k, s in want.items()), key=lambda r: (r[2], r[0], r[1]))[:80]
    edges = spark.createDataFrame([k for k, s in want.items() if s <= 18], "a long, b long")
    parts = {tuple(r) for r in matchers.perceptual_components(files, None, 18).collect()}
    assert parts == {tuple(r) for r in graph.connected_components(edges, "a", "b").collect()}


@pytest.mark.parametrize("least", [None, 0.0, 0.85])
def test_byte_strings(spark, least):
    rng = random.Random(2)
    rows = []
    for i in range(70):
        x = rng.randbytes(rng.choice([0, 1, 7, 8, 9, 200, 900]))
        if rows and i % 2:
            x = bytes(b ^ (1 << rng.randrange(8) if rng.random() < 0.3 else 0) for b in rng.choice(rows)[2])[: rng.choice([5, 100, 1000])]
        rows.append((i, rng.choice([5, 6]), x))
    df = spark.createDataFrame([(i, b, bytearray(x)) for i, b, x in rows], "id long, bucket int, value binary")
    want = {k: equal_bits(x, y) for k, (x, y) in allowed(rows).items()}
    want = {k: s for k, s in want.items() if least is None or s >= least}
    got = pairs_of(blocks.scored(blocking.window_blocks(df, "value", size=20), blocks.equal_bits(least, words=2)))
    assert got == pytest.approx(want)
    if least is None:  # the column form says the same
        x = df.select(F.col("id").alias("a"), F.col("value").alias("x")).crossJoin(df.select(F.col("id").alias("b"), F.col("value").alias("y")))
        by_column = {(r["a"], r["b"]): r["s"] for r in x.select("a", "b", kernels.byte_similarity("x", "y").alias("s")).collect()}
        assert {k: by_column[k] for k in want} == pytest.approx(want)


@pytest.mark.parametrize("kind", ["min", "max"])
def test_clusters_of_copies_and_near_ones(spark, kind):
    if kind == "min":
        rows = sequences(120, 5)
        rows += [(500 + i, 10, rows[4][2]) for i in range(40)] + [(600, 100, [7, 9]), (601, 100, [7, 9]), (602, 300, [7])]
        df = spark.createDataFrame([(i, b, [signed(h) for h in x]) for i, b, x in rows], "id long, bucket int, value array<long>")
        found = matchers.clusters_by_class(df, "value", blocks.best_match(12), 3, 0.0, "min")
        links = {k: s for k, (x, y) in allowed(rows).items() if (s := best_match(x, y)) <= 12}
    else:
        rng = random.Random(3)
        base = [rng.randbytes(40) for _ in range(12)]
        rows = [(i, rng.choice([5, 9]), bytes(b ^ (rng.random() < 0.4) for b in rng.choice(base))) for i in range(80)] + [(200 + i, 5, base[0]) for i in range(5)]
        df = spark.createDataFrame([(i, b, bytearray(x)) for i, b, x in rows], "id long, bucket int, value binary")
        found = matchers.clusters_by_class(df, "value", blocks.equal_bits(0.85), 3, 1.0, "max")
        links = {k: s for k, (x, y) in allowed(rows).items() if (s := equal_bits(x, y)) >= 0.85}
    best = {}
    for pair, s in links.items():
        for i in pair:
            best[i] = s if i not in best else (min if kind == "min" else max)(best[i], s)
    edges = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    want = {r["node"]: (r["component"], best[r["node"]]) for r in graph.connected_components(edges, "a", "b").collect()}
    got = {r["id"]: (r["component"], r["best"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})


def test_pair_stage_uses_all_cores(spark):
    df = spark.createDataFrame([(i, i % 40, [signed(i * 0x9E3779B97F4A7C15 % 2**64)]) for i in range(400)], "id long, bucket int, value array<long>")
    met = blocking.window_blocks(df, "value", size=10)
    tasks = {r["p"] for r in met.select(F.spark_partition_id().alias("p")).collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism


def test_empty(spark):
    df = spark.createDataFrame([], "id long, bucket int, value array<long>")
    assert blocking.duration_window_pairs(df).count() == 0
    assert blocks.scored(blocking.window_blocks(df, "value"), blocks.best_match(12)).count() == 0
    assert matchers.clusters_by_class(df, "value", blocks.best_match(12), 3, 0.0, "min").count() == 0


@pytest.mark.parametrize("size", [4, 1000])
def test_mean_jaccard(spark, size):
    rng = random.Random(8)
    words = "a b c d e f g h".split()
    rows = [(rng.choice("xyz"), i, rng.sample(words, rng.randrange(0, 5))) for i in range(90)] + [("one", 900, ["a"]), ("two", 901, []), ("two", 902, [])]
    rows += [("hot", 1000 + i, ["b", "a"] if i % 2 else ["a", "b"]) for i in range(300)] + [("hot", 2000, ["a"])]
    want = {}
    for g in {r[0] for r in rows}:
        sets = [set(t) for k, _, t in rows if k == g]
        js = [len(x & y) / len(x | y) if x and y else 0.0 for i, x in enumerate(sets) for y in sets[:i]]
        if js:
            want[g] = sum(js) / len(js)
    df = spark.createDataFrame(rows, "g string, id long, tokens array<string>")
    got = {r["g"]: r["similarity"] for r in matchers.mean_jaccard(df, "g", size).collect()}
    assert got == pytest.approx(want)


def test_hamming_pairs_of_a_hot_group_are_many_tasks(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 2]), signed(rng.getrandbits(64)) if i % 17 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, size long, h long")
    got = matchers.hamming_pairs(df, "size", "h", size=10).withColumn("p", F.spark_partition_id()).collect()
    mask = 2**64 - 1
    want = {(i, j): None if x is None or y is None else ((x ^ y) & mask).bit_count() for i, p, x in rows for j, q, y in rows if i < j and p == q}
    assert {(r["a"], r["b"]): r["score"] for r in got} == want and len(got) == len(want)
    assert len({r["p"] for r in got}) >= spark.sparkContext.defaultParallelism


def test_bounded_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(12)
    rows = [(i, f"/m/{rng.choice('xy')}/{rng.choice('pq')}/{i}.mp4", rng.sample("abcdefg", rng.randrange(0, 6))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, path string, tokens array<string>")
    parts = lambda f: {tuple(r) for r in graph.connected_components(f(df, 0.8, max_bucket=20, max_sub=25), "a", "b").collect()}
    assert parts(matchers.bounded_links) == parts(matchers.name_pairs)
    assert matchers.bounded_links(df, 0.8, max_bucket=20, max_sub=25).count() < matchers.name_pairs(df, 0.8, max_bucket=20, max_sub=25).count()


def test_first_bits_are_no_more_than_unrelated_prints_need(monkeypatch):
    """Of prints of 64 bytes the first half tells; the scores stay those of whole prints."""
    seen, real = [], blocks._signs
    monkeypatch.setattr(blocks, "_signs", lambda h: seen.append(h.shape[1]) or real(h))
    rng = random.Random(2)
    left = [rng.randbytes(64) for _ in range(30)]
    right = [bytes(b ^ (rng.random() < 0.4) for b in x) for x in left]
    found = {(int(i), int(j)): s for at, to, score in blocks.equal_bits(0.85)({"value_l": left, "value_r": right}) for i, j, s in zip(at, to, score)}
    assert seen == [4, 4]
    assert found == pytest.approx({(i, j): s for i, x in enumerate(left) for j, y in enumerate(right) if (s := equal_bits(x, y)) >= 0.85})


def test_a_file_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Blocks grow with the files that a file meets, so what is sent to be scored grows with the files and not with their pairs."""
    monkeypatch.setattr(blocking, "COPIES", 4)
    sent = {}
    for n in (400, 1600):
        rows = spark.range(n).select("id", F.lit(7).alias("bucket"), F.array(F.col("id")).alias("v"))
        pairs = blocking.window_blocks(rows, "v", size=10)
        sent[n] = pairs.agg(F.sum(F.size("id_l") + F.size("id_r"))).first()[0] / n
        got = blocks.scored(pairs, blocks.best_match()).select("a", "b")
        assert got.count() == got.distinct().count() == n * (n - 1) // 2
    assert max(sent.values()) <= 8


def test_a_large_pair_of_blocks_is_cut(spark):
    ids = np.arange(25)
    same = pd.Series({"id_l": ids, "id_r": ids, "value_l": ids * 2, "value_r": ids * 3, "bucket_l": 1, "same": True})
    met = [(int(a), int(b)) for r in blocks.cut(same, 10) for a in r["id_l"] for b in r["id_r"] if not r["same"] or a < b]
    assert sorted(met) == [(a, b) for a in range(25) for b in range(a + 1, 25)]
    other = [(int(a), int(b)) for r in blocks.cut(pd.Series({**same, "id_r": ids[:5] + 30, "same": False}), 10) for a in r["id_l"] for b in r["id_r"]]
    assert sorted(other) == [(a, b) for a in range(25) for b in range(30, 35)]


def test_pairs_are_opened_some_at_a_time(spark):
    """No generator, which would hold all pairs of two blocks at once; a file without an id pairs with none."""
    df = spark.createDataFrame([(i if i else None, i % 4) for i in range(40)], "id long, bucket int")
    out = blocking.duration_window_pairs(df, size=7)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(1, 40) for b in range(a + 1, 40)}
    met = blocks.scored(blocking.window_blocks(df.withColumn("v", F.array(F.lit(1).cast("long"))), "v", size=7), blocks.best_match())
    assert sorted((r["a"], r["b"]) for r in met.collect()) == sorted(got)
