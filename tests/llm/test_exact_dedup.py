import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import ODD, documents, empty, frame, odd
from twinsift.llm import exact_dedup as ed


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, np.uint64)
    f = ed.BinaryFuse.from_bytes(ed.BinaryFuse.build(keys).to_bytes())
    assert f.may_hold(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, np.uint64)
    assert f.may_hold(other).mean() < 0.001
    if n > 10_000:
        assert f.slots.nbytes < 2.6 * n


def brute(rows):
    groups = {}
    for i, text in rows:
        text = text or ""
        digest = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()
        groups.setdefault(digest, []).append((i, len(text)))
    out = []
    for digest, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] if m[0] is not None else 1 << 63))[0]
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    rows = [(r[0], r[1]) for r in documents(150) + ODD] + [(600 + i, "hot copy" + " " * (i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for incoming in (None, F.lit(True), F.lit(False), F.col("doc_id") > 100):
        incoming = incoming if incoming is None else F.coalesce(incoming, F.lit(False))
        assert sorted(map(tuple, ed.dedup(df, incoming).collect()), key=repr) == brute(rows)


def test_screen_lets_no_known_digest_pass(spark):
    rows = [(i, f"text {i}") for i in range(500)]
    old = ed.group(ed.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    new = ed.group(ed.digests(spark.createDataFrame([(i, f"text {i}") for i in range(250, 750)], "doc_id long, text string")))
    out = ed.screen(new.select("digest", "n", "best"), ed.snapshot_filters(old, 4), 4).collect()
    assert len(out) == 500 and sum(r["positive"] for r in out) in range(250, 256)


def test_bytes_are_checked(spark):
    df = spark.createDataFrame([(b"d", b"one"), (b"d", b"two"), (b"e", b"x"), (b"e", b"x")], "digest binary, body binary")
    assert {bytes(r["digest"]): r["equal"] for r in ed.check_bytes(df).collect()} == {b"d": False, b"e": True}


def test_ends_of_the_ids(spark):
    rows = [(i, text) for text in ("a", "b") for i in (None, (1 << 63) - 1, 0, -1, -(1 << 63))] + [(None, "c"), ((1 << 63) - 1, "c"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ed.dedup(df).collect()), key=repr) == brute(rows)


def test_odd_and_empty(spark):
    got = ed.dedup(odd(spark)).collect()
    assert len(got) == 11 and {r["doc_id"]: r["group_size"] for r in got}[5003] == 3
    assert ed.dedup(empty(spark)).count() == 0
    assert ed.dedup(frame(spark, [(1, None, "en", "s", 3)])).first()["kept"]
