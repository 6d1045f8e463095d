import datetime as dt

from twinsift.streaming import lifecycle


def stream(spark, tmp_path, rows, schema, batches=1):
    folder = tmp_path / "in"
    for i in range(batches):
        part = [r for j, r in enumerate(rows) if j % batches == i] if batches > 1 else rows
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return q


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_jobs_once(spark, tmp_path):
    df = stream(spark, tmp_path, [(1, at(0)), (1, at(5)), (2, at(6)), (1, at(7))], "id long, ts timestamp", 2)
    run(lifecycle.jobs(df), "jobs", "append", tmp_path)
    assert sorted(r["job"] for r in spark.table("jobs").collect()) == ["file-1", "file-2"]


def test_throughput_by_window(spark, tmp_path):
    df = stream(spark, tmp_path, [(at(0), 100), (at(60), 200), (at(1000), 1)], "ts timestamp, size long")
    run(lifecycle.throughput(df), "throughput", "complete", tmp_path)
    rows = {r["start"]: (r["files"], r["bytes"]) for r in spark.table("throughput").collect()}
    assert rows[at(0)] == (2, 300) and rows[at(60)] == (1, 200) and rows[at(-240)] == (1, 100)


def test_lifecycle_and_watchdog(spark, tmp_path):
    schema = "file_id long, ts timestamp, event string"
    folder = tmp_path / "in"
    for rows in ([(1, at(0), "claim"), (2, at(0), "claim"), (1, at(5), "done"), (1, at(6), "claim")], [(3, at(4000), "claim")], [(3, at(4001), "failed"), (3, at(4002), "claim")], [(4, at(4003), "claim")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run(lifecycle.lifecycle(df, stuck_seconds=1800), "states", "append", tmp_path)
    rows = [(r["file_id"], r["status"], r["attempts"], r["reason"]) for r in spark.table("states").collect()]
    assert (1, "done", 1, "done") in rows and not any(r[0] == 1 and r[2] == 2 for r in rows)
    assert (2, "pending", 1, "stuck") in rows
    assert (3, "failed", 1, "failed") in rows and (3, "processing", 2, "claim") in rows
