import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.functions import images, kernels


def popcount(x):
    return bin(x & (1 << 64) - 1).count("1")


def distance(a, b):
    if not a or not b:
        return 64.0
    one = lambda x, y: sum(min(popcount(p ^ q) for q in y) for p in x) / len(x)
    return (one(a, b) + one(b, a)) / 2


def test_best_match_distance(spark):
    rng = random.Random(1)
    some = lambda: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(6))]
    pairs = [([1, 3, -1], [1, 7]), ([], [1]), ([1], []), ([-1], [0])] + [(some(), some()) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    got = {r["i"]: r for r in df.select("i", kernels.best_match_distance("a", "b").alias("d"), kernels.best_match_distance("b", "a").alias("e"), kernels.best_match_distance("a", "a").alias("z")).collect()}
    assert got[0]["d"] == pytest.approx(10.583333, abs=1e-6)
    for i, (a, b) in enumerate(pairs):
        assert got[i]["d"] == pytest.approx(distance(a, b))
        assert got[i]["d"] == pytest.approx(got[i]["e"]) and 0 <= got[i]["d"] <= 64
        assert got[i]["z"] == (0 if a else 64)


def test_hamming(spark):
    df = spark.sql("select -1L a, 0L b, 5L c")
    assert df.select(kernels.hamming("a", "b"), kernels.hamming("c", "c")).first()[:] == (64, 0)


def test_byte_similarity(spark):
    rng = random.Random(2)
    rows = [(b"", b"x"), (b"abc", b"abc"), (b"abcdefgh", b"abcdefgi")] + [(rng.randbytes(rng.randrange(1, 40)), rng.randbytes(rng.randrange(1, 40))) for _ in range(40)]
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    df = spark.createDataFrame([(i, url(a), url(b)) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    got = {r[0]: r[1] for r in df.select("i", kernels.fingerprint_similarity("a", "b")).collect()}
    for i, (a, b) in enumerate(rows):
        n = min(len(a), len(b))
        want = 1 - sum(popcount(x ^ y) for x, y in zip(a, b)) / (8 * n) if n else 0.0  # noqa: B905
        assert got[i] == pytest.approx(want)


def test_content_hash(spark):
    text = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(bytearray(text.encode()), 26)], "c binary, n bigint")
    whole, part = df.select(kernels.content_hash("c", "n"), kernels.content_hash("c", "n", limit=0, sample=4)).first()
    assert whole == hashlib.sha256(text.encode()).hexdigest()
    assert part == hashlib.sha256(b"abcd" + (26).to_bytes(8, "big") + b"wxyz").hexdigest()


def test_jaccard_and_rounding(spark):
    df = spark.sql("select array('a','b') a, array('b','c') b, array() c")
    assert df.select(kernels.jaccard("a", "b")).first()[0] == pytest.approx(1 / 3)
    assert df.select(kernels.jaccard("a", F.col("c").cast("array<string>"))).first()[0] == 0
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,)], "d double").select(kernels.duration_bucket("d")).collect()
    assert [r[0] for r in got] == [0, 2, 2, 0]


def test_bytes_round_as_printf(spark):
    rng = random.Random(4)
    ns = [1280, 1792, 1024 * 1024 - 52, 1024**2 * 5 // 4, 1024**3 * 7 // 4, 2**53 + 2**50, *[rng.randrange(1024, 1 << rng.randrange(11, 62)) for _ in range(2000)]]
    ns += [(2 * k + 1) * 512 // 10 * 1024 for k in range(10, 3000)] + [1024 * k + 256 * j for k in range(1, 500) for j in (1, 3)]
    unit = lambda n: next(i for i in (1, 2, 3, 4) if i == 4 or n < 1024 ** (i + 1))
    want = [f"{float(n) / 1024 ** unit(n):.1f} {' KMGT'[unit(n)]}B" for n in ns]  # Python rounds as C does
    df = spark.createDataFrame(list(enumerate(ns)), "i long, n long").orderBy("i")
    assert [r[0] for r in df.select(kernels.human_bytes("n")).collect()] == want


def test_human(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1 << 30,), (5 << 40,), (5000 << 40,), (None,)], "n bigint")
    assert [r[0] for r in df.select(kernels.human_bytes("n")).collect()] == ["0 B", "1023 B", "1.0 KB", "1.0 GB", "5.0 TB", "5000.0 TB", "—"]
    df = spark.createDataFrame([(0.0,), (59.9,), (61.0,), (3661.0,), (None,)], "s double")
    assert [r[0] for r in df.select(kernels.human_duration("s")).collect()] == ["—", "0:59", "1:01", "1:01:01", "—"]


def test_frame_times(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (None,), (0.4,)], "d double")
    rows = [r[0] for r in df.select(kernels.frame_times("d", 3)).collect()]
    assert rows[0] == pytest.approx([5, 50, 95]) and rows[1] == [0.0] and rows[2] == [0.0]
    assert rows[3] == pytest.approx([0.5, 0.75, 1.0])
    assert df.select(kernels.frame_times("d", 1)).first()[0] == pytest.approx([50.0])


def test_phash_ignores_brightness():
    rng = np.random.default_rng(0)
    frame = rng.random(1024)
    assert images.phash(frame) == images.phash(frame * 0.5 + 3)
    assert images.phash(None) is None and images.phash(frame[:5]) is None
    other = images.phash(rng.random(1024))
    assert popcount(images.phash(frame) ^ other) > 10


def test_balanced():
    assert images.balanced('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert images.balanced("[1]") == "[1]" and images.balanced("{ no") is None and images.balanced("") is None
