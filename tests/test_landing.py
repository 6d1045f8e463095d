"""Periodic runs: only what is new, and a batch that runs twice counts once."""

from pyspark.sql import types as T

from twinsift.streaming import landing

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("status", T.StringType())])


def test_batches_land_once(spark, tmp_path):
    arrivals, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(arrivals)
    good = lambda batch: batch.filter("status <> 'noise'")
    add([(1, 1, "pending"), (2, 1, "pending"), (3, 1, "noise")])
    landing.take_in(stream(), out, progress, good).awaitTermination(90)
    add([(1, 2, "done"), (1, 1, "late"), (4, 2, "pending")])
    landing.take_in(stream(), out, progress, good).awaitTermination(90)
    landing.take_in(stream(), out, progress, good).awaitTermination(90)  # nothing new
    rows = landing.landed(spark, out, SCHEMA)
    want = [(1, 1, "late", 1), (1, 1, "pending", 0), (1, 2, "done", 1), (2, 1, "pending", 0), (4, 2, "pending", 1)]
    assert sorted(map(tuple, rows.collect())) == want
    again = spark.createDataFrame([(1, 2, "done"), (1, 1, "late"), (4, 2, "pending")], SCHEMA)
    landing.land(out, good)(again, 1)  # the second batch once more
    rows = landing.landed(spark, out, SCHEMA)
    assert sorted(map(tuple, rows.collect())) == want
    assert sorted(map(tuple, landing.latest(rows, "id", "ts").collect())) == [(1, 2, "done"), (2, 1, "pending"), (4, 2, "pending")]
