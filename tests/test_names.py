from pyspark.sql import functions as F

from twinsift.functions import names

CASES = [
    ("/m/Studio.25.03.12.Foo.XXX.1080p-WRB.mp4", "studio 25 03 12 foo", "1080p"),
    ("/m/Studio.25.03.12.Foo.XXX.720p-P2P.mp4", "studio 25 03 12 foo", "720p"),
    ("/m/Show.25.07.25.Ann.Lee.XXX.1080p.MP4-FETCH.mp4", "show 25 07 25 ann lee", "1080p"),
    ("/m/show.25.07.25.ann.lee.1.mp4", "show 25 07 25 ann lee", None),
    ("/m/Pack_00001.mp4", "pack 00001", None),
    ("/m/Pack_00002.mp4", "pack 00002", None),
    ("/m/Name-GRP[x].mkv", "name grp", None),
    ("/m/event 2024-01-15.mp4", "event 2024", None),
    ("/m/event 2024-01-20.mp4", "event 2024", None),
    ("/m/Film (1).mp4", "film", None),
    ("/m/title.web-dl.1080p.mkv", "title dl", "1080p"),
    ("/m/title.web-dl.mkv", "title", None),
    ("/m/.mkv", "", None),
    ("/m/Clip_01_02_03.mp4", "clip 01 02 03", None),
    ("/m/Vol 2.mp4", "vol", None),
    ("/4K/plain.mp4", "plain", "4k"),
    ("/m/Foo-Bar.mp4", "foo", None),
]


def test_keys_and_resolutions(spark):
    df = spark.createDataFrame([(p,) for p, _, _ in CASES], "path string")
    got = {r["path"]: r for r in df.select("path", names.name_key("path").alias("k"), names.resolution_label("path").alias("r"), names.resolution_rank("path").alias("n")).collect()}
    for path, key, label in CASES:
        assert got[path]["k"] == key, path
        assert got[path]["r"] == label, path
        assert got[path]["n"] == names.RESOLUTIONS.get(label, 0)


def test_tokens_leave_stopwords_out(spark):
    df = spark.createDataFrame([("/m/the.cat.and.the.hat.mkv",)], "path string")
    assert df.select(names.content_tokens("path")).first()[0] == ["cat", "hat"]


def test_classes(spark):
    df = spark.createDataFrame([("/a/B.MKV",), ("/a/b.flac",), ("/a/.mp4",), ("/a/x",)], "path string")
    assert [tuple(r) for r in df.select(names.extension("path"), names.media_type_of("path")).collect()] == [("mkv", "video"), ("flac", "audio"), ("", "audio"), ("", "audio")]
    assert set(names.extensions_for("both")) == set(names.VIDEO_EXTENSIONS) | set(names.AUDIO_EXTENSIONS)


def test_a_name_is_taken_apart_once(spark):
    """Not for each token and each look at its neighbours."""
    plan = spark.range(1).select(names.name_key(F.concat(F.lit("/m/a.b."), "id")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
