"""Blocking, matching, marking and changes on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.operators import actions, blocking, changes, keepers, matchers, proposals, reports


def test_window_pairs_follow_the_bucket_rule(spark):
    rng = random.Random(5)
    for buckets in ([10, 16], [10, 13, 16], [10, 17], [rng.randrange(60) for _ in range(40)]):
        df = spark.createDataFrame(list(enumerate(buckets)), "id bigint, bucket int")
        got = {tuple(r) for r in blocking.duration_window_pairs(df).collect()}
        have = set(buckets)
        want = {(i, j) for i, j in itertools.combinations(range(len(buckets)), 2) if any(max(buckets[i], buckets[j]) - 3 <= k <= min(buckets[i], buckets[j]) + 3 for k in have)}
        assert got == want


def test_large_buckets_are_cut_and_too_large_cuts_left_out(spark):
    rows = [(i, f"/d/s/n{i}.mp4", ["alpha", f"x{i}"]) for i in range(450)] + [(1000 + i, f"/d/t/n{i}.mp4", ["beta"]) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, path string, tokens array<string>")
    out = blocking.directory_buckets(blocking.directory_members(df)).collect()
    assert {(r["kind"], r["dir"]) for r in out} == {("dir", "/d/t"), ("grandparent", "/d")}
    assert {r["id"] for r in out} == {1000 + i for i in range(5)}


FILE = "id bigint, path string, media_type string, size bigint, width int, height int, bitrate int, priority int, match_type string, group_id bigint"


def test_marking_rules_differ(spark):
    def rows(kind, group):
        return [
            (1, "/long/path/a.mp4", "video", 5, 100, 100, 10, 0, kind, group),
            (2, "/b.mp4", "video", 50, 10, 10, 90, 0, kind, group),
            (3, "/c.mp4", "video", 50, None, None, 90, 0, kind, group),
        ]

    df = spark.createDataFrame(rows("exact", 1) + rows("perceptual", 2) + rows("chromaprint", 3) + rows("other", 4) + [(9, "/z", "video", 1, 1, 1, 1, None, "exact", 5)], FILE)
    kept = {r["group_id"]: r["file_id"] for r in keepers.auto_mark(df).filter("is_keeper").collect()}
    assert kept == {1: 1, 2: 1, 3: 2, 4: 1}
    first = spark.createDataFrame([(1, "/a", "video", 9, 9, 9, 9, None, "exact", 1), (2, "/b", "video", 1, 1, 1, 1, 4, "exact", 1)], FILE)
    assert {r["file_id"] for r in keepers.auto_mark(first).filter("is_keeper").collect()} == {2}
    ranks = {(r["group_id"], r["rank"]): r["file_id"] for r in keepers.auto_mark_ranked(df).collect()}
    assert ranks[1, 1] == 1 and ranks[3, 1] == 2


def test_effective_action(spark):
    df = spark.createDataFrame([(True, None), (False, None), (False, "ignore"), (True, "delete")], "is_keeper boolean, action string")
    assert [r[0] for r in df.select(actions.effective_action()).collect()] == ["keep", "delete", "ignore", "delete"]


def test_marks_by_hand_need_a_member_as_keeper(spark):
    members = spark.createDataFrame([(1, 10, True, None), (1, 11, False, None), (2, 20, True, None), (2, 21, False, None)], schema.MEMBERS)
    decisions = spark.createDataFrame([(1, 11, {10: "ignore"}), (2, 99, {})], "group_id bigint, keeper bigint, actions map<bigint,string>")
    got = {r["file_id"]: (r["is_keeper"], r["action"]) for r in actions.mark_by_hand(members, decisions).collect()}
    assert got == {10: (False, "ignore"), 11: (True, "keep"), 20: (True, None), 21: (False, None)}


def test_similarity_range():
    assert actions.checked_similarity(0.7) == 0.7
    with pytest.raises(ValueError):
        actions.checked_similarity(0.69)
    assert matchers.distance_threshold(None) == 12 and matchers.distance_threshold(0.8) == 13


def test_prefixes_end_at_a_part_of_the_path(spark):
    s = spark.createDataFrame([(1, "/media/a"), (2, "/media/a/sub/"), (3, "/")], "id bigint, path string")
    f = spark.createDataFrame([("/media/a/sub/x",), ("/media/ab/x",), ("/media/a/y",), ("/media/a",)], "path string")
    got = {r["path"]: r["source_id"] for r in changes.resolve_sources(f, s).collect()}
    assert got == {"/media/a/sub/x": 2, "/media/ab/x": 3, "/media/a/y": 1, "/media/a": 1}


def test_guard_is_strict_above_a_tenth(spark):
    files = spark.createDataFrame([(i, f"/f{i}", "done") for i in range(10)], "id bigint, path string, status string")
    for gone, allowed in ((1, True), (2, False)):
        listing = files.filter(F.col("id") >= gone)
        assert changes.missing_guard(files, listing).first()["allowed"] is allowed
        statuses = [r["status"] for r in changes.mark_missing(files, listing).collect()]
        assert statuses.count("missing") == (gone if allowed else 0)
    assert not changes.missing_guard(files, files, root_empty=True).first()["allowed"]


def test_reaper_leaves_unstarted_rows(spark):
    rows = [(1, "processing", "2024-01-01 00:00:00", None), (2, "processing", None, "old"), (3, "processing", "2024-01-01 00:50:00", None), (4, "processing", "2024-01-01 00:00:00", "old")]
    df = spark.createDataFrame(rows, "id bigint, status string, at string, error string").withColumn("processing_started_at", F.col("at").cast("timestamp_ntz"))
    got = {r["id"]: (r["status"], r["error"]) for r in changes.reap(df, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).collect()}
    assert got[1][0] == "pending" and got[2] == ("processing", "old") and got[3] == ("processing", None)
    assert got[4][1].startswith("old\n")


def test_finish_and_settle(spark):
    files = spark.createDataFrame([(1, "processing", None, None), (2, "processing", "was", None)], "id bigint, status string, error string, fingerprinted_at string")
    results = spark.createDataFrame([(1, "failed", "x" * 3000, "t"), (2, "done", None, "t")], "id bigint, outcome string, error string, at string")
    got = {r["id"]: r for r in changes.finish(files, results).collect()}
    assert len(got[1]["error"]) == 2000 and got[2]["error"] is None and got[2]["fingerprinted_at"] == "t"
    log = spark.createDataFrame([(1, "delete", False, 1), (1, "delete", True, 2), (2, "missing", False, 1)], "file_id bigint, action string, succeeded boolean, performed_at int")
    assert {r["id"]: r["status"] for r in actions.settle(files, log).collect()} == {1: "deleted", 2: "missing"}


def test_proposals_need_four_files_for_a_pair(spark):
    rows = spark.createDataFrame([(b, 0, p, n, 100 * i + p) for i, (b, n) in enumerate((("s", 3), ("t", 4), ("u", 20))) for p in range(1, n + 1)], "bucket string, batch bigint, pos bigint, batch_size bigint, id bigint")
    offers = spark.createDataFrame([("s", 0, 1, ["1", "2"], 0.9), ("t", 0, 1, ["1", "2"], 0.9), ("u", 0, 1, [str(i) for i in range(1, 10)], 0.9), ("u", 0, 2, ["1", "30"], 0.9), ("u", 0, 3, ["1", "2"], 0.79)], "bucket string, batch bigint, proposal int, members array<string>, confidence double")
    got = proposals.accepted(offers, rows).collect()
    assert {(r["bucket"], r["id"]) for r in got} == {("t", 101), ("t", 102)}


def test_match_all_on_no_files(spark):
    files = spark.createDataFrame([], schema.FILES)
    found = matchers.match_all(files)
    assert all(m.groups.count() == 0 and m.members.count() == 0 for m in found.values())
    assert matchers.filename_clusters(files.withColumn("priority", F.lit(0))).count() == 0
    assert reports.status_matrix(files).count() == 2


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "id int, extra string")
    out = schema.conform(df, schema.MEMBERS)
    assert out.columns == ["group_id", "file_id", "is_keeper", "action"]
    bad = spark.createDataFrame([(1, None, "video"), (2, "p", "text")], "id int, path string, media_type string")
    got = {r["id"]: r["broken"] for r in schema.violations(bad, schema.FILES, {"media_type": schema.MEDIA_TYPES}).collect()}
    assert got == {1: ["path"], 2: ["media_type"]}


def test_source_table(spark):
    from twinsift.operators import source_table as st

    s = spark.createDataFrame([(1, "a", "/m/a", "both", 0, True, None, None)], schema.SOURCES)
    s = st.create(s, name="b", path="/m/b/", priority=2)
    assert [r["path"] for r in st.by_name(s, "b").collect()] == ["/m/b"] and st.by_id(s, 2).first()["enabled"]
    with pytest.raises(ValueError):
        st.create(s, name="c", path="/m/a/")
    s = st.update(s, 1, enabled=False, notes=None, name="z")
    assert st.by_id(s, 1).first()[:2] == (1, "z") and not st.by_id(s, 1).first()["enabled"]
    files = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id bigint, source_id bigint")
    left, orphans = st.delete(s, files, 2)
    assert left.count() == 1 and {r["id"]: r["source_id"] for r in orphans.collect()} == {1: 1, 2: None, 3: None}
    folders = spark.createDataFrame([("/m/a/",), ("/m/b",)], "path string")
    assert [r["name"] for r in st.usable(s, folders).collect()] == ["b"]


def test_auto_delete(spark):
    groups = spark.createDataFrame([(1, "video", "exact", 1.0, None, False, None), (2, "video", "filename", 0.8, None, False, None)], schema.GROUPS)
    members = spark.createDataFrame([(1, 1, False, None), (1, 2, True, None), (2, 3, True, None), (2, 4, False, None)], schema.MEMBERS)
    files = schema.conform(spark.createDataFrame([(i, f"/m/a/{'long' * (i == 1)}{i}.mp4", "video", 10 * i, "done", 1) for i in range(1, 5)], "id bigint, path string, media_type string, size bigint, status string, source_id bigint"), schema.FILES)
    sources = spark.createDataFrame([(1, "a", "/m/a", "both", 0, True, None, None)], schema.SOURCES)
    plan, after = actions.auto_delete_exact(groups, members, files, sources, "20240102")
    assert [(r["file_id"], r["dst"], r["bytes_freed"]) for r in plan.collect()] == [(2, "/m/a/.trash/20240102/2__2.mp4", 20)]
    assert {r["id"]: r["reviewed"] for r in after.collect()} == {1: True, 2: False}
    plan, _ = actions.auto_delete(groups, members, files, sources, "20240102", ["filename"], mark=False)
    assert [r["file_id"] for r in plan.collect()] == [4]
    with pytest.raises(ValueError):
        actions.auto_delete(groups, members, files, sources, "d", threshold=0.5)
