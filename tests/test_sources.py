import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from twinsift.functions import images
from twinsift.sources import inventory, sinks


def test_listing(spark, tmp_path):
    for name, data in (("a/x.mp4", b"1"), ("a/.hidden.mp4", b"1"), (".dot/y.mp4", b"1"), ("a/empty.mkv", b""), ("a/note.txt", b"1"), ("b/s.flac", b"12")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    root = str(tmp_path)
    got = {r["path"].removeprefix(root): (r["size"], r["media_type"]) for r in inventory.listing(spark, root).collect()}
    assert got == {"/a/x.mp4": (1, "video"), "/b/s.flac": (2, "audio")}
    assert inventory.listing(spark, root, "audio").count() == 1


def test_media_info(spark):
    probe = {"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}, {"codec_type": "video", "codec_name": "h264", "width": 10, "height": "x"}, {"codec_type": "video", "codec_name": "b"}], "format": {"duration": "3.5", "bit_rate": "N/A"}}
    df = spark.createDataFrame([(json.dumps(probe),), ('{"format": {"duration": "0"}}',), ("no",)], "p string")
    rows = [r[0] for r in df.select(inventory.media_info(F.col("p"))).collect()]
    assert rows[0].asDict() == {"duration": 3.5, "width": 10, "height": None, "video_codec": "h264", "audio_codec": "aac", "bitrate": None, "sample_rate": 48000, "channels": 2}
    assert rows[1]["duration"] is None and rows[2]["width"] is None


def test_frames_plug_in(spark):
    def decode(batches):
        for b in batches:
            frames = [[list(map(float, np.random.default_rng(int(i)).random(1024)))] * int(i) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "frames": frames})

    df = spark.createDataFrame([(1, "/a"), (2, "/b"), (0, "/c")], "id bigint, path string")
    got = {r["id"]: r["phashes"] for r in inventory.with_fingerprints(df, decode).collect()}
    h = images.phash(np.random.default_rng(2).random(1024))
    assert got[2] == [h, h] and len(got[1]) == 1 and got[0] == []


def test_rebuild_replaces_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "groups")
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, match_type string, media_type string")
    sinks.rebuild(frame([(1, "filename", "video"), (2, "exact", "video")]), path)
    sinks.rebuild(frame([(3, "filename", "video")]), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_logs(spark, tmp_path):
    results = spark.createDataFrame([(1, "/a", "moved", 5, None), (2, "/b", "missing", 6, None), (3, "/c", "move_failed", 7, "disk")], "file_id bigint, path string, outcome string, size bigint, error string")
    log = {r["file_id"]: r for r in sinks.action_log(results, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert log[1]["succeeded"] and log[1]["bytes_freed"] == 5 and log[2]["action"] == "missing" and log[3]["error"] == "move_failed: disk"
    path = str(tmp_path / "log")
    sinks.append(results, path)
    sinks.append(results, path)
    assert spark.read.parquet(path).count() == 6
    run = sinks.run_log("matcher", spark.sql("select 3L as groups"), "x" * 3000).first()
    assert json.loads(run["stats"]) == {"groups": 3} and len(run["error"]) == 2000 and not run["succeeded"]
