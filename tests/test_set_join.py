"""The prefix join against all pairs."""

import random

import pytest

from twinsift.operators import graph, matchers, set_join

SCHEMA = "dir string, id long, tokens array<string>"


def brute(rows, t):
    """Links between classes' smallest ids, and from these to their copies; and the pairs of all."""
    rep, links, every = {}, {}, set()
    for d, i, x in sorted(rows, key=lambda r: r[1]):
        if x:
            key = d, frozenset(x)
            if key in rep:
                links[rep[key], i] = 1.0
            else:
                rep[key] = i
    for (d, x), i in rep.items():
        for (e, y), j in rep.items():
            if d == e and i < j and len(x & y) / len(x | y) >= t:
                links[i, j] = len(x & y) / len(x | y)
    for d, i, x in rows:
        for e, j, y in rows:
            if d == e and i < j and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= t:
                every.add((i, j))
    return links, every


def rows_of(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        if rows and i % 2:
            x = set(rng.choice(rows)[2])
            for _ in range(rng.choice([0, 1, 1, 2])):
                x ^= {rng.choice(words)}
        else:
            x = {min(rng.choice(words), rng.choice(words)) for _ in range(rng.randrange(0, 12))}
        rows.append((rng.choice("ab"), i, sorted(x, key=lambda _: rng.random())))
    return rows


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_against_all_pairs(spark, t):
    rows = rows_of(220, int(t * 10))
    found = set_join.similar_sets(spark.createDataFrame(rows, SCHEMA), ["dir"], t)
    got = {(r["a"], r["b"]): r["score"] for r in found.collect()}
    links, every = brute(rows, t)
    assert got == pytest.approx(links) and len(got) == found.count()
    one = {r["node"]: r["component"] for r in graph.connected_components(found.select("a", "b"), "a", "b").collect()}
    all_ = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(sorted(every), "a long, b long"), "a", "b").collect()}
    assert one == all_


def test_a_directory_of_many_files_is_whole(spark):
    """Names share four words, so all would pair by any one of these; their own number is what the index holds."""
    n = 20_000
    rows = spark.range(n).selectExpr("'one' as dir", "id", "array('the', 'same', 'show', 'again', concat('e', id div 2), concat('s', id % 2)) as tokens")
    near = rows.unionByName(spark.range(50).selectExpr("'one' as dir", f"{n} + id as id", "array('the', 'same', 'show', 'again', concat('e', id), 's0', 'extra') as tokens"))
    found = set_join.similar_sets(near, ["dir"], 0.8).collect()
    assert {(r["a"], r["b"]) for r in found} == {(2 * i, n + i) for i in range(50)}


def test_odd_rows(spark):
    rows = [("a", 1, []), ("a", 2, None), (None, 3, ["x"]), (None, 4, ["x"]), ("a", 5, ["x"]), ("a", 6, ["x"]), ("b", 7, ["x"])]
    assert [tuple(r) for r in set_join.similar_sets(spark.createDataFrame(rows, SCHEMA), ["dir"], 0.8).collect()] == [(5, 6, 1.0)]
    assert set_join.similar_sets(spark.createDataFrame([], SCHEMA), ["dir"], 0.8).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        set_join.similar_sets(spark.createDataFrame([], SCHEMA), ["dir"], 0.0)


def test_large_buckets_are_left_out_only_when_asked(spark):
    files = spark.createDataFrame([(i, f"/m/v/dir/alpha beta gamma delta eps{i}.mkv", "video", "done", 1, None) for i in range(500)] + [(900, "/m/v/dir/alpha beta gamma delta eps7 x.mkv", "video", "done", 1, None)], "id long, path string, media_type string, status string, size long, bitrate int")
    files = files.selectExpr("*", "0 as width", "0 as height", "0 as priority")
    ids = lambda **how: {r["id"] for r in matchers.filename_clusters(files, **how).collect()}
    assert ids() == {7, 900} and ids(exact=False) == set()
