"""A pass from files to groups with a provider that fails, stays silent and answers."""

import json

from pyspark.sql import functions as F

from twinsift.operators import proposal_pass as pp

FILES = "id long, path string, media_type string, status string, size long, width int, height int, bitrate int, priority int"


def files(spark):
    rows = [(10 * d + i, f"/m/dir{d}/d{d}f{i}.mkv", "video", "done", 100 + i, None, None, None, 0) for d in range(5) for i in range(6)]
    return spark.createDataFrame([*rows, (900, "/m/alone/x.mkv", "video", "done", 1, None, None, None, 0), (901, "/m/dir0/a.mp3", "audio", "done", 1, None, None, None, 0)], FILES)


def provider(fails=(), silent=()):
    """Proposes the first two, and all (too many); nothing at the first call for some, never for ``silent``."""
    seen = {}

    def call(prompt):
        n = seen[prompt] = seen.get(prompt, 0) + 1
        size = len(prompt.split("\n"))
        if size in fails:
            raise TimeoutError("no answer")
        if size in silent or (size == 6 and n == 1):
            return " "
        return "<think>{</think>```json\n" + json.dumps({"groups": [{"members": [1, 2], "confidence": 0.9}, {"members": list(range(1, size + 1)), "confidence": 0.99}, {"members": ["2", "3"], "confidence": 0.2}]}) + "\n```"

    return call


def groups(df):
    return sorted((r["group_id"], r["id"], r["similarity"], r["keeper"]) for r in df.collect())


WANT = sorted((10 * d, 10 * d + i, 0.9, 10 * d + 1) for d in range(5) for i in range(2))


def test_a_pass(spark, tmp_path):
    none = spark.createDataFrame([], "file_id long")
    assert groups(pp.run_pass(files(spark), none, provider(), f"{tmp_path}/log", waves=3)) == WANT
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert len(log) == 5 and all(r["tries"] == 2 and r["error"] is None and r["n_files"] == 6 for r in log)
    assert {r["prompt"].split("\n")[1] for r in log} == {f"2. d{d}f1.mkv" for d in range(5)}


def test_files_in_groups_are_left_out(spark, tmp_path):
    held = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 10)], "file_id long")
    got = groups(pp.run_pass(files(spark), held, provider(), f"{tmp_path}/log"))
    assert {g[0] for g in got} == {11, 20, 30, 40}  # one file alone isn't asked about


def test_what_failed_is_asked_again_and_nothing_else(spark, tmp_path):
    df, none, log = files(spark).filter("id <> 35"), spark.createDataFrame([], "file_id long"), f"{tmp_path}/log"
    first = groups(pp.run_pass(df, none, provider(fails=(5,)), log))
    assert first == [w for w in WANT if w[0] != 30]
    assert [r["error"] for r in spark.read.parquet(log).filter("error is not null").collect()] == ["TimeoutError: no answer"]
    second = groups(pp.run_pass(df, none, provider(silent=(5,)), log))
    assert second == first
    assert groups(pp.run_pass(df, none, provider(fails=(6,)), log)) == WANT
    calls = spark.read.parquet(log).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert {r["bucket"]: r["n"] for r in calls} == {f"/m/dir{d}": 3 if d == 3 else 1 for d in range(5)}
    assert groups(pp.run_pass(df, none, provider(fails=(5, 6)), log)) == WANT
    assert groups(pp.run_pass(df, none, provider(fails=(5, 6)), log, model="other")) == []


def test_answers_of_every_kind(spark):
    rows = [("b", i, "x", r) for i, r in enumerate(["no json", None, "{}", '{"groups": []}', '{"groups": [{"members": [1, "2"], "confidence": 1}]}'])]
    got = pp.proposed(spark.createDataFrame(rows, "bucket string, batch long, asked string, response string")).collect()
    assert [tuple(r) for r in got] == [("b", 4, 1, ["1", "2"], 1.0)]


def test_no_files(spark, tmp_path):
    assert groups(pp.run_pass(files(spark).limit(0), spark.createDataFrame([], "file_id long"), provider(), f"{tmp_path}/log")) == []
