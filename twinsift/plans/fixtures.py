"""Logical tables derived from the test tables, in Spark and as DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import names
from twinsift.operators import matchers
from twinsift.runtime import table

START = "2024-01-01 00:00:00"


def files_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from documents: English ones are videos, others audio; hashes, sizes and prints come from the text."""
    d = table(spark, sf_dir, "documents")
    words = F.split(F.lower(F.trim("text")), r"\s+")
    d = d.withColumn("words", words).withColumn("chunks", F.least(F.lit(16), F.greatest(F.lit(1), F.floor(F.size("words") / 8))).cast("int"))
    # chunks from the first word to the last, as frames are spread over a film
    start_of = lambda i: F.floor(i * (F.size("words") - 8) / F.greatest(F.col("chunks") - 1, F.lit(1))).cast("int") + 1
    chunk = lambda i: F.array_join(F.slice("words", start_of(i), F.lit(8)), " ")
    hashes = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.conv(F.substring(F.md5(chunk(i)), 1, 16), 16, -10).cast("bigint"))
    video = F.col("lang") == "en"
    whole = F.when(F.size("words") < 8, F.array(F.conv(F.substring(F.md5(F.array_join("words", " ")), 1, 16), 16, -10).cast("bigint"))).otherwise(hashes)
    # of all runs of three words the least hash in each of sixteen bins, so that a print covers the whole text
    # (by position: a slice would copy the whole array for each run)
    run = lambda i: F.md5(F.concat_ws(" ", *[F.get("words", i + k) for k in (-1, 0, 1)]))
    d = d.withColumn("runs", F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), run)))
    # sorted, so the least of a bin stands where the leading digit changes
    d = d.withColumn("runs", F.filter("runs", lambda r, i: (i == 0) | (F.substring(r, 1, 1) != F.substring(F.get("runs", i - 1), 1, 1))))
    least = lambda bin_: F.coalesce(F.substring(F.get(F.filter("runs", lambda r: r.startswith(bin_)), F.lit(0)), 2, 8), F.lit("00000000"))
    prints = F.when(F.col("text").isNotNull(), F.concat(*[least(b) for b in "0123456789abcdef"]))
    url = F.translate(F.regexp_replace(F.base64(F.unhex(prints)), r"[\r\n=]", ""), "+/", "-_")
    k = F.col("doc_id")
    status = F.when(k % 20 == 0, "failed").when(k % 20 == 1, "pending").when(k % 20 == 2, "processing").when(k % 20 == 3, "missing").when(k % 20 == 4, "deleted").otherwise("done")
    start = F.lit(START).cast("timestamp_ntz")
    seconds = F.col("n_chars") / 100.0
    began = start + F.make_dt_interval(secs=k % 1_000_000)
    return d.select(
        k.alias("id"),
        F.concat(F.lit("/media/"), "source", F.lit("/"), "lang", F.lit("/doc_"), k.cast("string"), F.when(video, ".mp4").otherwise(".mp3")).alias("path"),
        F.when(video, "video").otherwise("audio").alias("media_type"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        seconds.alias("duration"),
        F.when(video, whole).alias("phashes"),
        url.alias("chromaprint"),
        F.when(k % 10 == 0, 0.0).when(k % 7 == 0, F.lit(None)).otherwise(seconds).alias("chromaprint_dur"),
        status.alias("status"),
        F.get(F.array(F.lit(3840), F.lit(1920), F.lit(1280)), (k % 4).cast("int")).alias("width"),
        F.get(F.array(F.lit(2160), F.lit(1080), F.lit(720)), (k % 4).cast("int")).alias("height"),
        F.when(k % 11 != 0, (k * 7919 % 5000 * 1000).cast("int")).alias("bitrate"),
        F.when(k % 13 != 0, F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")).alias("source_id"),
        (start + F.make_dt_interval(mins=k % 1_000_000)).alias("mtime"),
        F.when(k % 20 >= 2, began).alias("processing_started_at"),
        F.when(k % 20 >= 5, began + F.make_dt_interval(secs=F.col("n_chars") % 60)).alias("fingerprinted_at"),
        F.when(k % 20 == 0, F.concat(F.lit("E"), k.cast("string"), F.lit("\ndetail"))).alias("error"),
        F.lit(0).alias("attempts"),
    )


FILES = r"""
files_words AS (SELECT *, string_split_regex(lower(trim(text)), '\s+') AS words FROM documents),
files_hex AS (SELECT *, list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: md5(array_to_string(list_slice(words, i, i + 2), ' '))) AS runs,
    CASE WHEN len(words) < 8 THEN [substr(md5(array_to_string(words, ' ')), 1, 16)]
    ELSE list_transform(range(0, least(16, len(words) // 8)), lambda i: substr(md5(array_to_string(list_slice(words, i * (len(words) - 8) // greatest(least(16, len(words) // 8) - 1, 1) + 1, i * (len(words) - 8) // greatest(least(16, len(words) // 8) - 1, 1) + 8), ' ')), 1, 16)) END AS hex FROM files_words),
files AS (SELECT doc_id AS id, '/media/' || source || '/' || lang || '/doc_' || doc_id || CASE WHEN lang = 'en' THEN '.mp4' ELSE '.mp3' END AS path,
    CASE WHEN lang = 'en' THEN 'video' ELSE 'audio' END AS media_type, n_chars AS size, sha256(text) AS sha256, n_chars / 100.0::DOUBLE AS duration,
    CASE WHEN lang = 'en' THEN list_transform(hex, lambda h: CASE WHEN ('0x' || h)::UBIGINT >= 9223372036854775808 THEN (('0x' || h)::UBIGINT::HUGEINT - 18446744073709551616)::BIGINT ELSE ('0x' || h)::UBIGINT::BIGINT END) END AS phashes,
    CASE WHEN text IS NOT NULL THEN translate(replace(base64(unhex(array_to_string(list_transform(string_split('0123456789abcdef', ''),
        lambda b: coalesce(substr(list_min(list_filter(runs, lambda r: r[1] = b)), 2, 8), '00000000')), ''))), '=', ''), '+/', '-_') END AS chromaprint,
    CASE WHEN doc_id % 10 = 0 THEN 0.0 WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars / 100.0::DOUBLE END AS chromaprint_dur,
    CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'missing' WHEN 4 THEN 'deleted' ELSE 'done' END AS status,
    CASE doc_id % 4 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 END AS width, CASE doc_id % 4 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 END AS height,
    CASE WHEN doc_id % 11 <> 0 THEN doc_id * 7919 % 5000 * 1000 END AS bitrate,
    CASE WHEN doc_id % 13 <> 0 THEN regexp_extract(source, '([0-9]+)', 1)::BIGINT END AS source_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 1000000) AS mtime,
    CASE WHEN doc_id % 20 >= 2 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 1000000) END AS processing_started_at,
    CASE WHEN doc_id % 20 >= 5 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 1000000 + n_chars % 60) END AS fingerprinted_at,
    CASE WHEN doc_id % 20 = 0 THEN 'E' || doc_id || chr(10) || 'detail' END AS error, 0 AS attempts FROM files_hex)
"""


def files_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos named from parts, with resolutions, tags and a word that makes near names."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.lower("p_type")
    even = k % 2 == 0
    label = F.get(F.array(*[F.lit(x) for x in (".2160p", ".1080p", ".720p", ".480p", "")]), (k % 5).cast("int"))
    path = F.concat(
        F.lit("/media/src"), (k % 4).cast("string"), F.lit("/"), kind, F.lit("/"), F.when(k % 9 == 0, "[tag] ").otherwise(""),
        F.when(even, F.replace("p_name", F.lit(" "), F.lit("."))).otherwise(F.col("p_name")), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("no")), F.lit("."), kind,
        F.when(k % 7 == 0, ".bonus").otherwise(""), label, F.when(k % 3 == 0, "-WRB").otherwise(""), F.when(even, ".mp4").otherwise(".mkv"),
    )
    status = F.when(k % 20 == 0, "failed").when(k % 20 == 1, "pending").when(k % 20 == 2, "processing").when(k % 20 == 3, "missing").when(k % 20 == 4, "deleted").otherwise("done")
    pick = lambda values: F.when(k % 3 == 0, F.get(F.array(*[F.lit(v) for v in values]), (k % 5).cast("int")))
    return p.select(
        k.alias("id"),
        path.alias("path"),
        F.lit("video").alias("media_type"),
        (F.col("p_retailprice") * 1000).cast("bigint").alias("size"),
        status.alias("status"),
        (k % 4).alias("source_id"),
        pick((3840, 1920, 1280, 854, None)).alias("width"),
        pick((2160, 1080, 720, 480, None)).alias("height"),
        F.lit(None).cast("int").alias("bitrate"),
        (k % 4 * 7 % 5 - 1).cast("int").alias("priority"),
    )


PARTS = r"""
parts AS (SELECT p_partkey AS id, '/media/src' || (p_partkey % 4) || '/' || lower(p_type) || '/' || CASE WHEN p_partkey % 9 = 0 THEN '[tag] ' ELSE '' END
    || CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '.') ELSE p_name END || '.' || replace(p_brand, '#', 'no') || '.' || lower(p_type)
    || CASE WHEN p_partkey % 7 = 0 THEN '.bonus' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '.2160p' WHEN 1 THEN '.1080p' WHEN 2 THEN '.720p' WHEN 3 THEN '.480p' ELSE '' END
    || CASE WHEN p_partkey % 3 = 0 THEN '-WRB' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.mp4' ELSE '.mkv' END AS path,
    'video' AS media_type, trunc(p_retailprice * 1000)::BIGINT AS size,
    CASE p_partkey % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'missing' WHEN 4 THEN 'deleted' ELSE 'done' END AS status,
    p_partkey % 4 AS source_id,
    CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 WHEN 3 THEN 854 END END AS width,
    CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 WHEN 3 THEN 480 END END AS height,
    NULL::INT AS bitrate, (p_partkey % 4) * 7 % 5 - 1 AS priority FROM part)
"""

_RES = "|".join(names.RESOLUTIONS)
_NOISE = ",".join(f"'{w}'" for w in names.NOISE)
_STOP = ",".join(f"'{w}'" for w in names.STOPWORDS)

NAMES = rf"""
name_base AS (SELECT *, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?s)^(\.*[^.].*)\.[^.]*$', '\1')) AS base FROM parts),
name_flat AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '[\[({{][^\])}}]*[\])}}]', ' ', 'g'),
    '-[a-z0-9]{{2,15}}(\[[a-z0-9]{{2,10}}\])?$', ''), '(^|[^a-z0-9])({_RES})($|[^a-z0-9])', '\1 \3', 'g'), '[._-]+', ' ', 'g') AS flat FROM name_base),
name_raw AS (SELECT *, list_filter(string_split_regex(flat, '\s+'), lambda t: t <> '' AND t NOT IN ({_NOISE})) AS raw FROM name_flat),
name_short AS (SELECT *, list_transform(raw, lambda t: regexp_full_match(t, '[0-9]{{1,2}}')) AS s FROM name_raw),
names AS (SELECT *, array_to_string(toks, ' ') AS name_key, list_filter(list_distinct(toks), lambda t: t NOT IN ({_STOP})) AS tokens FROM (
    SELECT *, list_filter(raw, lambda t, i: NOT s[i] OR (i > 2 AND s[greatest(i - 2, 1)] AND s[greatest(i - 1, 1)])
        OR (i > 1 AND coalesce(s[greatest(i - 1, 1)] AND s[i + 1], false)) OR coalesce(s[i + 1] AND s[i + 2], false)) AS toks FROM name_short)),
named AS (SELECT * FROM names WHERE status IN ('done', 'pending', 'processing'))
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each of the documents' sources, and one nested in the second."""
    d = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")
    own = d.select(n.alias("id"), F.col("source").alias("name"), F.concat(F.lit("/media/"), "source").alias("path"), (n * 7 % 5 - 1).cast("int").alias("priority"), (n % 6 != 0).alias("enabled"))
    nested = spark.range(1).select(F.lit(1001).cast("bigint").alias("id"), F.lit("nested").alias("name"), F.lit("/media/src1/en/").alias("path"), F.lit(3).alias("priority"), F.lit(True).alias("enabled"))
    return own.unionByName(nested)


SOURCES = """
sources AS (SELECT DISTINCT regexp_extract(source, '([0-9]+)', 1)::BIGINT AS id, source AS name, '/media/' || source AS path,
    (regexp_extract(source, '([0-9]+)', 1)::BIGINT * 7 % 5 - 1)::INT AS priority, regexp_extract(source, '([0-9]+)', 1)::BIGINT % 6 <> 0 AS enabled FROM documents
    UNION ALL SELECT 1001, 'nested', '/media/src1/en/', 3, true)
"""


def groups_doc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, members and files: exact groups over files of every status, dealt to all match types."""
    files = files_doc(spark, sf_dir)
    found = matchers.exact_clusters(files.withColumn("status", F.lit("done")))
    each = found.filter("id = group_id")
    g = F.col("group_id")
    match = F.get(F.array(*[F.lit(m) for m in ("exact", "perceptual", "chromaprint", "filename", "llm")]), (g % 5).cast("int"))
    groups = each.select(
        g.alias("id"), "media_type", match.alias("match_type"), F.when(g % 7 != 0, 0.7 + g % 30 / 100.0).alias("similarity"), (g % 3 == 0).alias("reviewed"),
        F.when((g % 5 == 3) & (g % 11 != 0), F.when(g % 2 == 0, "resolution_only").otherwise("name_differs")).alias("notes"),
    )
    f = F.col("file_id")
    members = found.select("group_id", F.col("id").alias("file_id")).select(
        "group_id", "file_id", (f == g).alias("is_keeper"), F.get(F.array(F.lit(None), F.lit("keep"), F.lit("delete"), F.lit("ignore")), ((g + f) % 4).cast("int")).alias("action")
    )
    return groups, members, files


GROUPS = """
group_rows AS (SELECT *, min(id) OVER (PARTITION BY media_type, sha256) AS group_id, count(*) OVER (PARTITION BY media_type, sha256) AS held FROM files),
groups_ AS (SELECT DISTINCT group_id AS id, media_type, CASE group_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'perceptual' WHEN 2 THEN 'chromaprint' WHEN 3 THEN 'filename' ELSE 'llm' END AS match_type,
    CASE WHEN group_id % 7 <> 0 THEN 0.7::DOUBLE + (group_id % 30) / 100.0::DOUBLE END AS similarity, group_id % 3 = 0 AS reviewed,
    CASE WHEN group_id % 5 = 3 AND group_id % 11 <> 0 THEN CASE WHEN group_id % 2 = 0 THEN 'resolution_only' ELSE 'name_differs' END END AS notes FROM group_rows WHERE held > 1),
members AS (SELECT group_id, id AS file_id, id = group_id AS is_keeper, CASE (group_id + id) % 4 WHEN 1 THEN 'keep' WHEN 2 THEN 'delete' WHEN 3 THEN 'ignore' END AS action FROM group_rows WHERE held > 1),
joined AS (SELECT m.*, g.media_type, g.match_type, g.similarity, g.reviewed, g.notes, f.* EXCLUDE (media_type) FROM members m JOIN groups_ g ON g.id = m.group_id JOIN files f ON f.id = m.file_id)
"""


def listing_doc(files: DataFrame) -> DataFrame:
    """A later listing of the files: some gone, some grown, some new."""
    k = F.col("id")
    kept = files.filter(k % 17 != 0).select("path", (F.col("size") + F.when(k % 19 == 0, 1).otherwise(0)).alias("size"), "mtime", "media_type")
    new = files.filter(k % 23 == 0).select(F.concat("path", F.lit(".new.mp4")).alias("path"), "size", "mtime", "media_type")
    return kept.unionByName(new)


LISTING = """
listing AS (SELECT path, size + CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END AS size, mtime, media_type FROM files WHERE id % 17 <> 0
    UNION ALL SELECT path || '.new.mp4', size, mtime, media_type FROM files WHERE id % 23 = 0)
"""


def proposals_part(batched: DataFrame) -> DataFrame:
    """Proposals for each batch as a model would answer: the first two files; all; the first two without
    confidence; and one file with a position out of range and no number."""
    def one(number: int, members, confidence: float):
        return F.struct(F.lit(number).alias("proposal"), members.alias("members"), F.lit(confidence).alias("confidence"))

    text = lambda *xs: F.array(*[F.lit(x) for x in xs])
    every = F.transform(F.sequence(F.lit(1), F.col("batch_size").cast("int")), lambda i: i.cast("string"))
    sizes = batched.groupBy("bucket", "batch").agg(F.first("batch_size").alias("batch_size"))
    offers = F.explode(F.array(one(1, text("1", "2"), 0.9), one(2, every, 0.95), one(3, text("1", "2"), 0.5), one(4, text("3", "99", "x"), 0.99), one(5, text("2", " 3 "), 0.8)))
    return sizes.select("bucket", "batch", offers.alias("o")).select("bucket", "batch", "o.*")


def answer(prompt: str) -> str:
    """What a provider says to a numbered listing, by rule: the first two files; all; the second and third."""
    n = prompt.count("\n") + 1
    offers = (([1, 2], 0.9), (list(range(1, n + 1)), 0.95), ([2, 3], 0.8))
    return "Here you are:\n" + json.dumps({"groups": [{"members": m, "confidence": c} for m, c in offers]})


def runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type in ('signup', 'error')")
    k = F.col("event_id")
    ended = F.col("ts") + F.make_dt_interval(secs=F.floor(F.abs("value")))
    return e.select(k.alias("id"), F.when(F.col("user_id") % 2 == 0, "scanner").otherwise("matcher").alias("kind"), F.col("ts").alias("started_at"), F.when(k % 9 != 0, ended).alias("finished_at"), (F.col("event_type") == "signup").alias("succeeded"))


RUNS = """
runs AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'scanner' ELSE 'matcher' END AS kind, ts AS started_at,
    CASE WHEN event_id % 9 <> 0 THEN ts + to_seconds(floor(abs(value))::BIGINT) END AS finished_at, event_type = 'signup' AS succeeded FROM events WHERE event_type IN ('signup', 'error'))
"""


def calls_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with answers of every kind."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'view')")
    k = F.col("event_id")
    good = '{"groups": [{"members": [1, 2], "confidence": 0.9}, {"members": [4], "confidence": 0.9}, {"members": [5, 6, 7], "confidence": 0.4}]}'
    answers = (good, "# model: x\n<think>{no}</think>```json\n" + good + "\n```", "Here: " + good + " done", "{}", "no json", "", '{"groups": []}')
    answer = F.get(F.array(*[F.lit(a) for a in answers]), (k % 7).cast("int"))
    return e.select(k.alias("id"), F.col("ts").alias("created_at"), (k % 30 + 1).cast("int").alias("n_files"), F.floor(F.col("value") * 100).cast("int").alias("elapsed_ms"), answer.alias("response"), F.when(k % 10 == 0, "timeout").alias("error"))


CALLS = """
calls AS (SELECT event_id AS id, ts AS created_at, (event_id % 30 + 1)::INT AS n_files, floor(value * 100)::INT AS elapsed_ms, event_id % 7 AS kind,
    CASE WHEN event_id % 10 = 0 THEN 'timeout' END AS error FROM events WHERE event_type IN ('click', 'view'))
"""
