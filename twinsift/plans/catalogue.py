"""Every query by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.functions import kernels, names
from twinsift.operators import actions, blocking, changes, keepers, matchers, proposal_pass, proposals, reports, source_table
from twinsift.plans import fixtures as fx
from twinsift.runtime import checkpoint, checkpoint_dir, table
from twinsift.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_CTES = {"files": fx.FILES, "parts": fx.PARTS, "named": fx.NAMES, "sources": fx.SOURCES, "groups": fx.GROUPS, "listing": fx.LISTING, "runs": fx.RUNS, "calls": fx.CALLS}
_NEEDS = {"groups": ("files",), "listing": ("files",), "named": ("parts",)}


def sql(body: str, *needs: str, more: str = "") -> str:
    """``body`` behind the common tables that it needs and ``more`` of its own."""
    order: list[str] = []
    for n in needs:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    tables = ",".join([*[_CTES[n].strip() for n in order], *([more.strip()] if more else [])])
    return f"WITH RECURSIVE {tables}\n{body}" if tables else body


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- exact groups, kernels


@query(sql("SELECT media_type, min(id) AS group_id, count(*) AS n, 1.0::DOUBLE AS similarity, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, min(id) AS keeper FROM files WHERE status = 'done' AND sha256 IS NOT NULL GROUP BY media_type, sha256 HAVING count(*) > 1", "files"))
def exact_groups(spark, d):
    out = matchers.gathered(matchers.exact_clusters(fx.files_doc(spark, d)))
    return out.select("media_type", "group_id", F.size("ids").cast("bigint").alias("n"), "similarity", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "keeper")


@query("SELECT doc_id AS id, CASE WHEN octet_length(encode(text)) <= 1000 THEN sha256(text) ELSE sha256(unhex(substr(hex(encode(text)), 1, 128) || printf('%016x', octet_length(encode(text))) || substr(hex(encode(text)), 2 * octet_length(encode(text)) - 127, 128))) END AS hash FROM documents")
def sha_partial(spark, d):
    content = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), kernels.content_hash(content, F.length(content).cast("bigint"), limit=1000, sample=64).alias("hash"))


@query(sql("SELECT DISTINCT a.id AS a, b.id AS b, bit_count(xor(a.phashes[1], b.phashes[1]))::INT AS distance FROM v a JOIN v b ON a.size // 100 = b.size // 100 AND a.id < b.id", "files", more="v AS (SELECT * FROM files WHERE phashes IS NOT NULL AND status = 'done')"))
def hamming_pairs(spark, d):
    v = _files(spark, d, "phashes").filter("phashes is not null and status = 'done'")
    v = v.select("id", F.floor(F.col("size") / 100).alias("bin"), F.get("phashes", F.lit(0)).alias("h"))
    return matchers.hamming_pairs(v, "bin", "h").withColumnRenamed("score", "distance")


_EXACT = "exact_ids AS (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY media_type, sha256) AS n FROM files WHERE status = 'done') WHERE n > 1)"
_WINDOW = """
centres AS (SELECT DISTINCT bucket FROM cands),
at_ AS (SELECT id, bucket + o AS centre FROM cands, range(-3, 4) r(o) WHERE bucket + o IN (SELECT bucket FROM centres)),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM at_ x JOIN at_ y USING (centre) WHERE x.id < y.id)
"""
_VIDEO = "cands AS (SELECT id, round_even(coalesce(duration, 0), 0)::INT AS bucket, phashes FROM files WHERE media_type = 'video' AND status = 'done' AND len(phashes) > 0 {without})"
_AUDIO = "cands AS (SELECT id, round_even(coalesce(nullif(chromaprint_dur, 0), duration, 0), 0)::INT AS bucket, hex(from_base64(rpad(translate(chromaprint, '-_', '+/'), ((length(chromaprint) + 3) // 4 * 4)::INT, '='))) AS fp FROM files WHERE media_type = 'audio' AND status = 'done' AND chromaprint IS NOT NULL AND id NOT IN (SELECT id FROM exact_ids))"
_BEST = "(list_avg(list_transform({a}, lambda x: list_min(list_transform({b}, lambda y: bit_count(xor(x, y))::INT)))) + list_avg(list_transform({b}, lambda x: list_min(list_transform({a}, lambda y: bit_count(xor(x, y))::INT))))) / 2".format(a="x.phashes", b="y.phashes")
_VPAIRS = f"scored AS (SELECT a, b, {_BEST} AS score FROM pairs JOIN cands x ON x.id = a JOIN cands y ON y.id = b)"
_BYTES = "1 - list_sum(list_transform(range(0, least(length(x.fp), length(y.fp)) // 2), lambda i: bit_count(xor(('0x' || substr(x.fp, 2 * i + 1, 2))::UBIGINT, ('0x' || substr(y.fp, 2 * i + 1, 2))::UBIGINT))::INT)) / (4.0::DOUBLE * least(length(x.fp), length(y.fp)))"
_APAIRS = f"scored AS (SELECT a, b, {_BYTES} AS score FROM pairs JOIN cands x ON x.id = a JOIN cands y ON y.id = b)"
_OUTSIDE = "AND id NOT IN (SELECT id FROM exact_ids)"


#: What a fingerprinter made of each file; queries that read neither don't compute it.
_PRINTS = ("phashes", "chromaprint")


def _files(spark, d, *prints):
    return checkpoint(fx.files_doc(spark, d).drop(*[p for p in _PRINTS if p not in prints]))


def _without(spark, d, *prints):
    files = _files(spark, d, *prints)
    return files, checkpoint(matchers.exact_member_ids(files))


@query(sql("SELECT a, b FROM pairs", "files", more=",".join([_EXACT, _VIDEO.format(without=_OUTSIDE), _WINDOW])))
def duration_window_candidates(spark, d):
    return blocking.duration_window_pairs(matchers.perceptual_candidates(*_without(spark, d, "phashes")))


@query(sql("SELECT a, b, round(score, 6) AS score FROM scored", "files", more=",".join([_EXACT, _VIDEO.format(without=_OUTSIDE), _WINDOW, _VPAIRS])))
def best_match_pairs(spark, d):
    return matchers.perceptual_pairs(*_without(spark, d, "phashes")).select("a", "b", F.round("score", 6).alias("score"))


@query(sql("SELECT a, b, round(score, 6) AS score FROM scored", "files", more=",".join([_EXACT, _AUDIO, _WINDOW, _APAIRS])))
def byte_similarity_pairs(spark, d):
    return matchers.acoustic_pairs(*_without(spark, d, "chromaprint")).select("a", "b", F.round("score", 6).alias("score"))


_REACH = """
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, spot) AS (SELECT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.spot),
parts_of AS (SELECT id, min(spot) AS component FROM reach GROUP BY id)
"""


@query(sql("SELECT id, component FROM parts_of", "files", more=",".join([_EXACT, _VIDEO.format(without=""), _WINDOW, _VPAIRS, "edges AS (SELECT a, b FROM scored WHERE score <= 18)", _REACH])))
def components_of_pairs(spark, d):
    return matchers.perceptual_components(_files(spark, d, "phashes"), None, 18)


_BEST_OF = "best AS (SELECT id, {f}(score) AS best FROM (SELECT a AS id, score FROM edges UNION ALL SELECT b, score FROM edges) GROUP BY id)"


@query(sql("SELECT 'video' AS media_type, component AS group_id, count(*) AS n, round(greatest(0.0, 1 - avg(best) / 64), 6) AS similarity, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM parts_of JOIN best USING (id) GROUP BY component", "files", more=",".join([_EXACT, _VIDEO.format(without=_OUTSIDE), _WINDOW, _VPAIRS, "edges AS (SELECT * FROM scored WHERE score <= 12)", _REACH, _BEST_OF.format(f="min")])))
def perceptual_clusters(spark, d):
    return _clusters(matchers.perceptual_clusters(*_without(spark, d, "phashes")))


def _clusters(c):
    return matchers.gathered(c).select("media_type", "group_id", F.size("ids").cast("bigint").alias("n"), F.round("similarity", 6).alias("similarity"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(sql("SELECT component AS group_id, arg_max(f.id, (f.size, length(path), -f.id)) AS keeper FROM parts_of p JOIN files f ON f.id = p.id GROUP BY component", "files", more=",".join([_EXACT, _VIDEO.format(without=_OUTSIDE), _WINDOW, _VPAIRS, "edges AS (SELECT * FROM scored WHERE score <= 12)", _REACH])))
def keeper_perceptual(spark, d):
    return matchers.perceptual_clusters(*_without(spark, d, "phashes")).select("group_id", "keeper").distinct()


@query(sql("SELECT 'audio' AS media_type, component AS group_id, count(*) AS n, round(avg(best), 6) AS similarity, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM parts_of JOIN best USING (id) GROUP BY component", "files", more=",".join([_EXACT, _AUDIO, _WINDOW, _APAIRS, "edges AS (SELECT * FROM scored WHERE score >= 0.85)", _REACH, _BEST_OF.format(f="max")])))
def acoustic_clusters(spark, d):
    return _clusters(matchers.acoustic_clusters(*_without(spark, d, "chromaprint")))


@query(sql("SELECT component AS group_id, arg_max(f.id, (coalesce(bitrate, 0), f.size, -f.id)) AS keeper FROM parts_of p JOIN files f ON f.id = p.id GROUP BY component", "files", more=",".join([_EXACT, _AUDIO, _WINDOW, _APAIRS, "edges AS (SELECT * FROM scored WHERE score >= 0.85)", _REACH])))
def keeper_acoustic(spark, d):
    return matchers.acoustic_clusters(*_without(spark, d, "chromaprint")).select("group_id", "keeper").distinct()


@query(sql("SELECT round_even(score, 0)::INT AS distance, count(*) AS n, sum(count(*)) OVER (ORDER BY round_even(score, 0)::INT)::BIGINT AS cumulative FROM scored GROUP BY 1", "files", more=",".join([_VIDEO.format(without=""), _WINDOW, _VPAIRS])))
def phash_histogram(spark, d):
    return reports.distance_histogram(matchers.perceptual_distances(_files(spark, d, "phashes"), None))


@query(sql("SELECT a, b, round(score, 6) AS score FROM scored ORDER BY score, a, b LIMIT 10", "files", more=",".join([_VIDEO.format(without=""), _WINDOW, _VPAIRS])))
def closest_pairs(spark, d):
    return matchers.closest_perceptual(_files(spark, d, "phashes"), None).select("a", "b", F.round("score", 6).alias("score"))


@query(sql("SELECT id FROM files WHERE media_type = 'video' AND status = 'done' AND len(phashes) > 0 AND id NOT IN (SELECT id FROM exact_ids)", "files", more=_EXACT))
def anti_exact(spark, d):
    return matchers.perceptual_candidates(*_without(spark, d, "phashes")).select("id")


# ---------------------------------------------------------------- names


@query(sql(f"SELECT id, nullif(label, '') AS label, coalesce(CASE label {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in names.RESOLUTIONS.items())} END, 0) AS rank FROM (SELECT id, regexp_extract(lower(path), '(?:^|[^a-z0-9])({'|'.join(names.RESOLUTIONS)})(?:$|[^a-z0-9])', 1) AS label FROM parts)", "parts"))
def resolution_extract(spark, d):
    return fx.files_part(spark, d).select("id", names.resolution_label("path").alias("label"), names.resolution_rank("path").alias("rank"))


@query(sql("SELECT id, name_key FROM names", "named"))
def name_normalize(spark, d):
    return fx.files_part(spark, d).select("id", names.name_key("path").alias("name_key"))


@query(sql("SELECT id, array_to_string(list_sort(tokens), ' ') AS tokens FROM names", "named"))
def content_tokens(spark, d):
    return fx.files_part(spark, d).select("id", F.array_join(F.array_sort(names.content_tokens("path")), " ").alias("tokens"))


@query(sql("SELECT media_type, name_key, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n FROM named WHERE name_key <> '' GROUP BY media_type, name_key HAVING count(*) > 1", "named"))
def filename_exact_key(spark, d):
    out = matchers.gathered(matchers.name_key_groups(matchers.named(fx.files_part(spark, d))).drop("group_id"))
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


_SINGLE = "singles AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY media_type, name_key) AS held FROM named WHERE name_key <> '') WHERE held = 1)"


@query(sql("SELECT id FROM singles", "named", more=_SINGLE))
def filename_singletons(spark, d):
    return matchers.name_singletons(matchers.named(fx.files_part(spark, d))).select("id")


_DIRS = """
placed AS (SELECT id, tokens, 'dir' AS kind, regexp_replace(path, '/[^/]*$', '') AS dir FROM singles
    UNION ALL SELECT id, tokens, 'grandparent', regexp_replace(path, '/[^/]*/[^/]*$', '') FROM singles),
sized AS (SELECT *, count(*) OVER (PARTITION BY kind, dir) AS held FROM placed),
cut_ AS (SELECT *, CASE WHEN held > 200 THEN coalesce(list_min(list_filter(tokens, lambda t: regexp_matches(t, '[a-z]'))), list_min(tokens), '_empty_') END AS sub FROM sized WHERE held > 1),
buckets AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY kind, dir, sub) AS n FROM cut_) WHERE n > 1 AND (sub IS NULL OR n <= 400)),
close_ AS (SELECT DISTINCT x.id AS a, y.id AS b, x.tokens AS ta, y.tokens AS tb FROM buckets x JOIN buckets y ON x.kind = y.kind AND x.dir = y.dir AND x.sub IS NOT DISTINCT FROM y.sub AND x.id < y.id),
scored AS (SELECT a, b, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) ELSE 0 END AS score FROM close_)
"""


@query(sql("SELECT kind, dir, sub, id, n FROM buckets", "named", more=",".join([_SINGLE, _DIRS])))
def filename_sub_buckets(spark, d):
    singles = matchers.name_singletons(matchers.named(fx.files_part(spark, d)))
    return blocking.directory_buckets(blocking.directory_members(singles)).select("kind", "dir", "sub", "id", "n")


@query(sql("SELECT kind, sum(n * (n - 1) / 2)::BIGINT AS pairs, count(*) AS buckets, max(n) AS largest FROM (SELECT kind, dir, count(*) AS n FROM placed GROUP BY kind, dir) GROUP BY kind", "named", more=",".join([_SINGLE, _DIRS])))
def filename_pair_cost(spark, d):
    singles = matchers.name_singletons(matchers.named(fx.files_part(spark, d)))
    return blocking.pair_cost(blocking.directory_members(singles).groupBy("kind", "dir").agg(F.count("*").alias("n")))


@query(sql("SELECT a, b, round(score, 6) AS score FROM scored WHERE score >= 0.5", "named", more=",".join([_SINGLE, _DIRS])))
def filename_dir_pairs(spark, d):
    singles = matchers.name_singletons(matchers.named(fx.files_part(spark, d)))
    return matchers.name_pairs(singles, 0.5).select("a", "b", F.round("score", 6).alias("score"))


_BY_NAME = """
edges AS (SELECT a, b FROM scored WHERE score >= 0.8),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, spot) AS (SELECT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.spot),
parts_of AS (SELECT id, min(spot) AS component FROM reach GROUP BY id),
toks AS (SELECT p.component, s.id, s.tokens FROM parts_of p JOIN singles s USING (id)),
mean_ AS (SELECT x.component, avg(len(list_intersect(x.tokens, y.tokens))::DOUBLE / len(list_distinct(list_concat(x.tokens, y.tokens)))) AS similarity FROM toks x JOIN toks y ON x.component = y.component AND x.id < y.id GROUP BY x.component),
by_name AS (SELECT min(id) OVER (PARTITION BY media_type, name_key) AS group_id, id, 1.0::DOUBLE AS similarity, 'resolution_only' AS notes FROM (SELECT *, count(*) OVER (PARTITION BY media_type, name_key) AS held FROM named WHERE name_key <> '') WHERE held > 1
    UNION ALL SELECT component, id, similarity, 'name_differs' FROM parts_of JOIN mean_ USING (component))
"""


@query(sql("SELECT 'video' AS media_type, group_id, round(similarity, 6) AS similarity, notes, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM by_name GROUP BY group_id, similarity, notes", "named", more=",".join([_SINGLE, _DIRS, _BY_NAME])))
def filename_clusters(spark, d):
    out = matchers.gathered(matchers.filename_clusters(fx.files_part(spark, d), exact=False))
    return out.select("media_type", "group_id", F.round("similarity", 6).alias("similarity"), "notes", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_RANK = f"coalesce(CASE regexp_extract(lower(path), '(?:^|[^a-z0-9])({'|'.join(names.RESOLUTIONS)})(?:$|[^a-z0-9])', 1) {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in names.RESOLUTIONS.items())} END, 0)"


@query(sql(f"SELECT group_id, arg_max(id, (priority, {_RANK}, coalesce(width * height, 0), coalesce(bitrate, 0), size, -id)) AS keeper FROM by_name JOIN parts USING (id) GROUP BY group_id", "named", more=",".join([_SINGLE, _DIRS, _BY_NAME])))
def keeper_filename(spark, d):
    return matchers.filename_clusters(fx.files_part(spark, d), exact=False).select("group_id", "keeper").distinct()


@query(sql("SELECT component AS group_id, round(avg(len(list_intersect(x.tokens, y.tokens))::DOUBLE / len(list_distinct(list_concat(x.tokens, y.tokens)))), 6) AS similarity FROM k x JOIN k y USING (component) WHERE x.id < y.id GROUP BY component", "named", more="k AS (SELECT id, tokens, regexp_extract(path, '^(/[^/]*/[^/]*/[^/]*)', 1) AS component FROM named)"))
def pairwise_group_jaccard(spark, d):
    rows = matchers.named(fx.files_part(spark, d)).select("id", "tokens", F.regexp_extract("path", "^(/[^/]*/[^/]*/[^/]*)", 1).alias("group_id"))
    return matchers.mean_jaccard(rows, "group_id").select("group_id", F.round("similarity", 6).alias("similarity"))


@query(sql("SELECT count(*) AS candidates, (SELECT count(DISTINCT group_id) FROM by_name WHERE notes = 'resolution_only') AS exact_key_groups, (SELECT count(DISTINCT group_id) FROM by_name WHERE notes = 'name_differs') AS token_set_groups, (SELECT count(*) FROM by_name) AS members FROM named", "named", more=",".join([_SINGLE, _DIRS, _BY_NAME])))
def filename_stats(spark, d):
    files = fx.files_part(spark, d)
    found = matchers.matches(checkpoint(matchers.filename_clusters(files, exact=False)), "filename")
    return reports.match_stats(found.groups, found.members, matchers.named(files))


# ---------------------------------------------------------------- names, directories whole

_WHOLE = """
placed AS (SELECT id, list_sort(tokens) AS tokens, 'dir' AS kind, regexp_replace(path, '/[^/]*$', '') AS dir FROM singles
    UNION ALL SELECT id, list_sort(tokens), 'grandparent', regexp_replace(path, '/[^/]*/[^/]*$', '') FROM singles),
classes AS (SELECT *, min(id) OVER (PARTITION BY kind, dir, tokens) AS rep FROM placed WHERE len(tokens) > 0),
reps AS (SELECT * FROM classes WHERE id = rep),
near AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.tokens, y.tokens))::DOUBLE / len(list_distinct(list_concat(x.tokens, y.tokens))) AS score FROM reps x JOIN reps y USING (kind, dir) WHERE x.id < y.id),
scored AS (SELECT DISTINCT * FROM (SELECT * FROM near UNION ALL SELECT rep, id, 1.0 FROM classes WHERE id > rep))
"""


@query(sql("SELECT a, b, round(score, 6) AS score FROM scored WHERE score >= 0.5", "named", more=",".join([_SINGLE, _WHOLE])))
def filename_links(spark, d):
    singles = matchers.name_singletons(matchers.named(fx.files_part(spark, d)))
    return matchers.name_links(singles, 0.5).select("a", "b", F.round("score", 6).alias("score"))


@query(sql("SELECT 'video' AS media_type, group_id, id, round(similarity, 6) AS similarity, notes FROM by_name", "named", more=",".join([_SINGLE, _WHOLE, _BY_NAME])))
def filename_clusters_whole(spark, d):
    return matchers.filename_clusters(fx.files_part(spark, d)).select("media_type", "group_id", "id", F.round("similarity", 6).alias("similarity"), "notes")


# ---------------------------------------------------------------- marking, previews, plans


def _marking(kind: str) -> str:
    path, area, rate = ("length(path)", "0", "0") if kind == "exact" else ("0", "0" if kind == "chromaprint" else "coalesce(width, 0) * coalesce(height, 0)", "coalesce(bitrate, 0)")
    return f"(coalesce(priority, -1), {path}, {area}, {rate}, size, -file_id)"


_MARK = f"""
ranked AS (SELECT j.*, s.priority, CASE match_type WHEN 'exact' THEN {_marking('exact')} WHEN 'chromaprint' THEN {_marking('chromaprint')} ELSE {_marking('other')} END AS o FROM joined j LEFT JOIN (SELECT id AS sid, priority FROM sources) s ON s.sid = j.source_id),
best AS (SELECT group_id, arg_max(file_id, o) AS keeper FROM ranked GROUP BY group_id HAVING count(*) > 1)
"""


@query(sql("SELECT group_id, file_id, file_id = keeper AS is_keeper, CASE WHEN file_id = keeper THEN 'keep' ELSE 'delete' END AS action FROM ranked JOIN best USING (group_id)", "groups", "sources", more=_MARK))
def auto_mark(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    return actions.marked(groups, members, files, fx.sources(spark, d))


@query(sql("SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY o DESC)::INT AS rank FROM ranked", "groups", "sources", more=_MARK))
def marking_order(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    rows = actions.joined(groups, members, files).join(fx.sources(spark, d).select(F.col("id").alias("source_id"), "priority"), "source_id", "left")
    return keepers.auto_mark_ranked(rows)


_PREVIEW = "each AS (SELECT group_id, media_type, match_type, any_value(similarity) AS similarity, coalesce(any_value(notes), 'unknown') AS note, count(*) AS n, sum(size) AS total, max(size) AS largest FROM joined WHERE NOT reviewed GROUP BY group_id, media_type, match_type)"
_SUMS = "count(*) AS groups, sum(n - 1)::BIGINT AS files_to_delete, sum(total - largest)::BIGINT AS bytes_to_free"


@query(sql(f"SELECT media_type, match_type, {_SUMS} FROM each WHERE similarity >= 0.75 GROUP BY media_type, match_type", "groups", more=_PREVIEW))
def preview_by_type(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    return actions.preview(actions.selected(groups, min_similarity=0.75), members, files).drop("avg_similarity")


@query(sql(f"SELECT note, {_SUMS} FROM each WHERE match_type = 'filename' GROUP BY note", "groups", more=_PREVIEW))
def preview_filename(spark, d):
    return reports.note_buckets(*fx.groups_doc(spark, d))


@query(sql(f"SELECT match_type, {_SUMS}, round(avg(similarity), 6) AS avg_similarity FROM each WHERE match_type = 'llm' GROUP BY match_type", "groups", more=_PREVIEW))
def preview_llm(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    out = actions.preview(actions.selected(groups, ["llm"]), members, files, ["match_type"])
    return out.withColumn("avg_similarity", F.round("avg_similarity", 6))


@query(sql(f"SELECT media_type, match_type, groups, files_to_delete, bytes_to_free, {'{h}'} AS reclaimable FROM (SELECT media_type, match_type, {_SUMS} FROM each GROUP BY media_type, match_type UNION ALL SELECT 'TOTAL', '', count(*), coalesce(sum(n - 1), 0)::BIGINT, coalesce(sum(total - largest), 0)::BIGINT FROM each)", "groups", more=_PREVIEW).replace("{h}", "CASE WHEN bytes_to_free < 1024 THEN printf('%d B', bytes_to_free) WHEN bytes_to_free < 1048576 THEN printf('%.1f KB', bytes_to_free / 1024.0::DOUBLE) ELSE printf('%.1f MB', bytes_to_free / 1048576.0::DOUBLE) END"))
def preview_total(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    return actions.with_total(actions.preview(actions.selected(groups), members, files))


@query(sql("SELECT media_type, sum(total - coalesce(kept, 0))::BIGINT AS wasted FROM (SELECT group_id, media_type, sum(size) AS total, max(size) FILTER (is_keeper) AS kept FROM joined GROUP BY group_id, media_type) GROUP BY media_type", "groups"))
def wasted_space(spark, d):
    return reports.wasted_space(*fx.groups_doc(spark, d))


@query(sql("SELECT media_type, effective, count(*) AS files, count(*) FILTER (effective = 'delete' AND NOT is_keeper) AS to_delete, coalesce(sum(size) FILTER (effective = 'delete' AND NOT is_keeper), 0)::BIGINT AS bytes_freed FROM (SELECT *, coalesce(action, CASE WHEN is_keeper THEN 'keep' ELSE 'delete' END) AS effective FROM joined) GROUP BY media_type, effective", "groups"))
def effective_action_summary(spark, d):
    _, members, files = fx.groups_doc(spark, d)
    return actions.summary(members, files)


_FOUND = r"""
prefixed AS (SELECT f.path, s.id, rtrim(s.path, '/') AS prefix FROM files f JOIN sources s ON f.path = rtrim(s.path, '/') OR starts_with(f.path, rtrim(s.path, '/') || '/')),
found AS (SELECT path, arg_max(id, length(prefix)) AS found, arg_max(prefix, length(prefix)) AS prefix FROM prefixed GROUP BY path)
"""


@query(sql("SELECT f.id, found AS source_id, prefix AS source_path FROM files f LEFT JOIN found USING (path)", "files", "sources", more=_FOUND))
def resolve_source(spark, d):
    return changes.resolve_sources(fx.files_doc(spark, d), fx.sources(spark, d)).select("id", "source_id", "source_path")


@query(sql("SELECT f.id, coalesce(source_id, found) AS source_id FROM files f LEFT JOIN found USING (path)", "files", "sources", more=_FOUND))
def backfill_source(spark, d):
    return changes.backfill_sources(fx.files_doc(spark, d), fx.sources(spark, d)).select("id", "source_id")


@query(sql("SELECT group_id, file_id, path AS src, coalesce(s.path, prefix, '/' || media_type) || '/.trash/20240101/' || file_id || '__' || regexp_extract(j.path, '([^/]*)$', 1) AS dst, CASE WHEN status IN ('missing', 'deleted') THEN 0 ELSE size END AS bytes_freed, CASE WHEN status IN ('missing', 'deleted') THEN 'missing' ELSE 'move' END AS outcome FROM (SELECT *, coalesce(action, CASE WHEN is_keeper THEN 'keep' ELSE 'delete' END) AS effective FROM joined) j LEFT JOIN (SELECT id AS sid, path FROM sources) s ON s.sid = j.source_id LEFT JOIN (SELECT path AS fpath, prefix FROM found) q ON q.fpath = j.path AND j.source_id IS NULL WHERE effective = 'delete' AND NOT is_keeper".replace("path AS src", "j.path AS src"), "groups", "sources", more=_FOUND))
def effective_action_plan(spark, d):
    return actions.plan(*fx.groups_doc(spark, d), fx.sources(spark, d), "20240101")


@query(sql("SELECT id, coalesce(s.path, prefix, '/' || media_type) || '/.trash' AS trash FROM files f LEFT JOIN (SELECT id AS sid, path FROM sources) s ON s.sid = f.source_id LEFT JOIN (SELECT path AS fpath, prefix FROM found) q ON q.fpath = f.path".replace("SELECT id,", "SELECT f.id,"), "files", "sources", more=_FOUND))
def trash_root(spark, d):
    files, roots = fx.files_doc(spark, d), fx.sources(spark, d)
    by_path = changes.resolve_sources(files.select("id", "path"), roots).select("id", "source_path")
    own = files.join(roots.select(F.col("id").alias("source_id"), F.col("path").alias("root")), "source_id", "left").join(by_path, "id")
    return own.select("id", F.concat(F.coalesce("root", "source_path", F.concat(F.lit("/"), F.col("media_type"))), F.lit("/.trash")).alias("trash"))


# ---------------------------------------------------------------- reports


_LIST = "rows_ AS (SELECT group_id, media_type, match_type, similarity, reviewed, count(*) AS n_members, sum(size)::BIGINT AS total_size, max(size) FILTER (is_keeper) AS keeper_size FROM joined GROUP BY ALL), list_ AS (SELECT *, total_size - coalesce(keeper_size, 0) AS reclaimable FROM rows_)"


@query(sql("SELECT * FROM list_ ORDER BY reclaimable DESC NULLS LAST, group_id LIMIT 20 OFFSET 20", "groups", more=_LIST))
def group_list_page(spark, d):
    return reports.group_list(*fx.groups_doc(spark, d), page=2, per_page=20)


@query(sql("SELECT * FROM list_ WHERE media_type = 'video' AND NOT reviewed ORDER BY similarity ASC NULLS LAST, group_id LIMIT 200", "groups", more=_LIST))
def group_list_by_similarity(spark, d):
    return reports.group_list(*fx.groups_doc(spark, d), sort="similarity", order="asc", per_page=500, media_type="video", reviewed="no")


@query(sql("SELECT file_id, path, size, is_keeper, action FROM joined WHERE group_id = (SELECT min(group_id) FROM members)", "groups"))
def group_detail(spark, d):
    groups, members, files = fx.groups_doc(spark, d)
    return reports.group_detail(groups.agg(F.min("id")).first()[0] or 0, members, files)


@query(sql("SELECT media_type, match_type, count(DISTINCT g.id) AS groups, count(m.file_id) AS members FROM groups_ g LEFT JOIN members m ON m.group_id = g.id GROUP BY media_type, match_type", "groups"))
def group_stats(spark, d):
    groups, members, _ = fx.groups_doc(spark, d)
    return reports.group_stats(groups, members)


@query(sql("SELECT count(DISTINCT g.id) AS groups, count(m.file_id) AS members FROM groups_ g LEFT JOIN members m ON m.group_id = g.id WHERE match_type = 'llm'", "groups"))
def llm_landed(spark, d):
    groups, members, _ = fx.groups_doc(spark, d)
    return reports.landed(groups, members)


@query(sql("SELECT media_type, status, count(*) AS n, sum(size)::BIGINT AS total_size FROM files GROUP BY media_type, status", "files"))
def file_stats(spark, d):
    return reports.file_stats(fx.files_doc(spark, d))


@query(sql("SELECT status, count(*) AS n FROM files GROUP BY status", "files"))
def status_counts(spark, d):
    return reports.status_counts(fx.files_doc(spark, d))


_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "processing", "done", "failed", "missing", "deleted"))


@query(sql(f"SELECT media_type, {_STATUS} FROM files GROUP BY media_type", "files"))
def status_matrix(spark, d):
    return reports.status_matrix(fx.files_doc(spark, d))


@query(sql(f"SELECT s.id, name, priority, count(f.id) AS files, {_STATUS} FROM sources s LEFT JOIN files f ON f.source_id = s.id GROUP BY s.id, name, priority", "files", "sources"))
def source_counts(spark, d):
    return reports.source_counts(fx.sources(spark, d), fx.files_doc(spark, d))


@query(sql("SELECT id, name, priority FROM sources WHERE enabled ORDER BY priority DESC, name", "sources"))
def sources_listed(spark, d):
    return reports.listed_sources(fx.sources(spark, d), True).select("id", "name", "priority")


_NOW = "TIMESTAMP '2024-01-01 01:00:00'"
_now = lambda: F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")


@query(sql(f"SELECT id, regexp_extract(path, '([^/]*)$', 1) AS name, media_type, size, floor(epoch({_NOW} - processing_started_at))::BIGINT AS elapsed_s FROM files WHERE status = 'processing'", "files"))
def in_flight(spark, d):
    files = fx.files_doc(spark, d)
    return reports.in_flight(files.withColumn("processing_started_at", F.col("processing_started_at").cast("timestamp")), _now().cast("timestamp"))


@query(sql("SELECT id, regexp_extract(path, '([^/]*)$', 1) AS name, media_type, size, round(epoch(fingerprinted_at - processing_started_at), 1)::DOUBLE AS took_s FROM files WHERE status = 'done' AND fingerprinted_at IS NOT NULL ORDER BY fingerprinted_at DESC, id LIMIT 10", "files"))
def recent_done(spark, d):
    files = fx.files_doc(spark, d)
    return reports.recent_done(files.withColumns({c: F.col(c).cast("timestamp") for c in ("processing_started_at", "fingerprinted_at")}))


@query(sql("SELECT id, regexp_extract(path, '([^/]*)$', 1) AS name, media_type, split_part(error, chr(10), 1) AS error FROM files WHERE status = 'failed' ORDER BY id DESC LIMIT 5", "files"))
def recent_failed(spark, d):
    return reports.recent_failed(fx.files_doc(spark, d))


@query("SELECT count(*) AS files, sum(floor(value * 1000000)::BIGINT)::BIGINT AS bytes, round(count(*) / 5.0::DOUBLE, 1) AS files_per_min, round(sum(floor(value * 1000000)::BIGINT)::DOUBLE / 1048576.0 / 300.0, 1) AS mb_per_sec FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE")
def throughput_5min(spark, d):
    e = table(spark, d, "events").select("ts", F.floor(F.col("value") * 1000000).cast("bigint").alias("bytes"))
    last = e.agg(F.max("ts")).first()[0]
    return reports.throughput(e, F.lit(last).cast("timestamp_ntz"), "ts", "bytes")


@query(sql("SELECT id, kind, started_at, finished_at, succeeded FROM runs WHERE kind = 'matcher' ORDER BY started_at DESC, id DESC LIMIT 20", "runs"))
def recent_runs(spark, d):
    return reports.recent_runs(fx.runs_events(spark, d), 20, "matcher")


@query(sql("SELECT count(*) AS calls, round(avg(elapsed_ms), 6) AS avg_ms, sum(n_files)::BIGINT AS files FROM calls WHERE created_at >= (SELECT min(created_at) + INTERVAL 1 HOUR FROM calls)", "calls"))
def llm_calls_window(spark, d):
    calls = fx.calls_events(spark, d)
    start = calls.agg(F.min("created_at") + F.make_dt_interval(hours=F.lit(1))).first()[0]
    return reports.calls_since(calls, F.lit(start).cast("timestamp_ntz")).select("calls", F.round("avg_ms", 6).alias("avg_ms"), "files")


@query(sql("SELECT id, created_at, n_files FROM calls ORDER BY created_at DESC, id DESC LIMIT 50", "calls"))
def recent_calls(spark, d):
    return reports.recent_calls(fx.calls_events(spark, d), 50).select("id", "created_at", "n_files")


@query(sql("SELECT id, state, CASE WHEN state = 'ok' THEN CASE kind WHEN 6 THEN 0 ELSE 2 END END AS groups_found, CASE WHEN state = 'ok' THEN CASE kind WHEN 6 THEN 0 ELSE 5 END END AS members_found FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'errored' WHEN kind = 5 THEN 'empty' WHEN kind IN (3, 4) THEN 'unparseable' ELSE 'ok' END AS state FROM calls)", "calls"))
def llm_outcomes(spark, d):
    return proposals.outcomes(fx.calls_events(spark, d))


@query(sql("SELECT count(*) FILTER (media_type = 'video' AND status = 'done' AND len(phashes) > 0) AS videos_hashed, count(*) FILTER (media_type = 'audio' AND chromaprint IS NOT NULL) AS audio_fingerprinted, count(*) AS files FROM files", "files"))
def coverage(spark, d):
    return reports.coverage(fx.files_doc(spark, d))


# ---------------------------------------------------------------- proposals


_BATCHED = ",".join([_SINGLE, _DIRS, _BY_NAME]) + """,
asked AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS bucket FROM parts WHERE status IN ('done', 'pending', 'processing') AND id NOT IN (SELECT id FROM by_name)),
counted AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS held, row_number() OVER (PARTITION BY bucket ORDER BY path, id) - 1 AS nth FROM asked),
batched AS (SELECT id, bucket, nth // 30 AS batch, nth % 30 + 1 AS pos, least(30, held - nth // 30 * 30) AS batch_size FROM counted WHERE held >= 2)
"""
_TAKEN = """
good AS (SELECT DISTINCT bucket, batch, batch_size FROM batched WHERE batch_size >= 4),
offers AS (SELECT bucket, batch, 1 AS proposal, 0.9::DOUBLE AS confidence, unnest([1, 2]) AS pos FROM good UNION ALL SELECT bucket, batch, 5, 0.8, unnest([2, 3]) FROM good),
taken AS (SELECT o.bucket, o.batch, o.proposal, o.confidence, b.id FROM offers o JOIN batched b USING (bucket, batch, pos))
"""


def _ungrouped(files):
    """Files in no group of the name matcher."""
    return proposals.ungrouped(files, matchers.filename_clusters(files, exact=False).select(F.col("id").alias("file_id")))


def _batched(spark, d):
    files = fx.files_part(spark, d)
    return checkpoint(proposals.batches(_ungrouped(files))), files


@query(sql("SELECT id FROM asked", "named", more=_BATCHED))
def any_group_anti(spark, d):
    return _ungrouped(fx.files_part(spark, d)).select("id")


@query(sql("SELECT id, bucket, batch, pos, batch_size FROM batched", "named", more=_BATCHED))
def llm_batches(spark, d):
    return _batched(spark, d)[0].select("id", "bucket", "batch", "pos", "batch_size")


@query(sql("SELECT bucket, batch, proposal, confidence, id FROM taken", "named", more=_BATCHED + "," + _TAKEN))
def llm_proposal_filter(spark, d):
    rows, _ = _batched(spark, d)
    return proposals.accepted(fx.proposals_part(rows), rows).select("bucket", "batch", "proposal", "confidence", "id")


@query(sql("SELECT min(id) AS group_id, arg_max(id, (priority, coalesce(width * height, 0), size, -id)) AS keeper, 0.9::DOUBLE AS similarity FROM (SELECT DISTINCT bucket, batch, id FROM taken) JOIN parts USING (id) GROUP BY bucket, batch", "named", more=_BATCHED + "," + _TAKEN))
def keeper_llm(spark, d):
    rows, files = _batched(spark, d)
    taken = checkpoint(proposals.accepted(fx.proposals_part(rows), rows))
    return proposals.proposal_clusters(taken, files).select("group_id", "keeper", "similarity").distinct()


@query(sql("SELECT 'video' AS media_type, min(id) OVER (PARTITION BY bucket, batch) AS group_id, id, 0.9::DOUBLE AS similarity FROM (SELECT DISTINCT bucket, batch, id FROM taken)", "named", more=_BATCHED + "," + _TAKEN))
def llm_pass(spark, d):
    files = checkpoint(fx.files_part(spark, d))
    members = matchers.filename_clusters(files, exact=False).select(F.col("id").alias("file_id"))
    ledger = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return proposal_pass.run_pass(files, members, fx.answer, ledger, waves=2).drop("keeper")


# ---------------------------------------------------------------- changes


@query(sql("SELECT path, change, CASE WHEN change IN ('new', 'changed') THEN l.size ELSE f.size END AS size, CASE WHEN change IN ('new', 'changed') THEN 'pending' ELSE status END AS status, CASE WHEN change = 'new' THEN 77 WHEN change = 'same' THEN coalesce(source_id, 77) ELSE source_id END AS source_id, CASE WHEN change IN ('new', 'changed') THEN NULL ELSE sha256 END AS sha256 FROM (SELECT coalesce(f.path, l.path) AS path, CASE WHEN f.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'unseen' WHEN f.size <> l.size OR f.mtime <> l.mtime THEN 'changed' ELSE 'same' END AS change FROM files f FULL JOIN listing l ON l.path = f.path) LEFT JOIN files f USING (path) LEFT JOIN listing l USING (path)", "listing"))
def scan_upsert(spark, d):
    files = _files(spark, d)
    return changes.upsert(files, fx.listing_doc(files), F.lit(77)).select("path", "change", "size", "status", "source_id", "sha256")


@query(sql("SELECT live, missing, round(missing / live::DOUBLE, 6) AS share, missing / live::DOUBLE <= 0.1 AS allowed FROM (SELECT count(*) AS live, count(*) FILTER (path NOT IN (SELECT path FROM listing)) AS missing FROM files WHERE status NOT IN ('missing', 'deleted'))", "listing"))
def missing_guard(spark, d):
    files = _files(spark, d)
    return changes.missing_guard(files, fx.listing_doc(files)).withColumn("share", F.round("share", 6))


@query(sql("SELECT id, CASE WHEN path NOT IN (SELECT path FROM listing) AND status NOT IN ('missing', 'deleted') THEN 'missing' ELSE status END AS status FROM files", "listing"))
def mark_missing(spark, d):
    files = _files(spark, d)
    return changes.mark_missing(files, fx.listing_doc(files)).select("id", "status")


@query(sql(f"SELECT id, CASE WHEN stuck THEN 'pending' ELSE status END AS status, CASE WHEN NOT stuck THEN processing_started_at END AS processing_started_at, CASE WHEN stuck THEN coalesce(nullif(error, '') || chr(10), '') || 'requeued: processing for more than 3000 s' ELSE error END AS error FROM (SELECT *, coalesce(status = 'processing' AND processing_started_at < {_NOW} - INTERVAL 3000 SECOND, false) AS stuck FROM files)", "files"))
def reap_stuck(spark, d):
    return changes.reap(fx.files_doc(spark, d), _now(), 3000).select("id", "status", "processing_started_at", "error")


@query("SELECT event_type AS key, arg_max(value, (ts, event_id)) AS value, max(ts) AS updated_at FROM events GROUP BY event_type")
def settings_latest(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("at"), F.col("ts").alias("updated_at"))
    return changes.latest(e, "at")


@query(sql("SELECT id, 'file-' || id AS job, size FROM files WHERE status = 'pending'", "files"))
def work_queue(spark, d):
    return changes.work_queue(fx.files_doc(spark, d))


@query("SELECT user_id AS file_id, arg_max(status, event_id) AS status, count(*) FILTER (status = 'processing') AS attempts FROM (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'missing' END AS status FROM events) GROUP BY user_id")
def file_status_fold(spark, d):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "pending", "click", "processing", "purchase", "done", "error", "failed", "signup", "missing")])
    e = table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("status"))
    return changes.fold_status(e)


@query(sql("SELECT id, CASE WHEN status IN ('pending', 'failed') THEN 'processing' ELSE status END AS status, CASE WHEN status IN ('pending', 'failed') THEN 1 ELSE 0 END AS attempts FROM files", "files"))
def claim_files(spark, d):
    files = fx.files_doc(spark, d)
    return changes.claim(files, files.select("id"), _now()).select("id", "status", "attempts")


# ---------------------------------------------------------------- decisions and what follows them


@query(sql(f"SELECT id, coalesce(outcome, status) AS status, CASE WHEN outcome IS NULL THEN error WHEN outcome <> 'done' THEN 'why ' || id END AS error, CASE WHEN outcome = 'done' THEN {_NOW} ELSE fingerprinted_at END AS fingerprinted_at FROM (SELECT *, CASE WHEN status = 'processing' THEN CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'missing' END END AS outcome FROM files)", "files"))
def finish_files(spark, d):
    files = fx.files_doc(spark, d)
    k = F.col("id")
    outcome = F.when(k % 3 == 0, "done").when(k % 3 == 1, "failed").otherwise("missing")
    ended = files.filter("status = 'processing'").select("id", outcome.alias("outcome"), F.concat(F.lit("why "), k.cast("string")).alias("error"), _now().alias("at"))
    return changes.finish(files, ended).select("id", "status", "error", "fingerprinted_at")


@query(sql("SELECT group_id, file_id, coalesce(file_id = keeper, is_keeper) AS is_keeper, CASE WHEN keeper IS NULL THEN action WHEN group_id % 3 = 0 AND file_id = group_id THEN 'ignore' WHEN file_id = keeper THEN 'keep' ELSE 'delete' END AS action FROM members LEFT JOIN (SELECT group_id, max(file_id) AS keeper FROM members WHERE group_id % 2 = 0 GROUP BY group_id) USING (group_id)", "groups"))
def mark_by_hand(spark, d):
    """Even groups get another keeper; the keepers of odd ones are no members, so nothing changes there."""
    _, members, _ = fx.groups_doc(spark, d)
    g = F.col("group_id")
    last = members.groupBy("group_id").agg(F.max("file_id").alias("last"))
    decisions = last.select("group_id", F.when(g % 2 == 0, F.col("last")).otherwise(-1).alias("keeper"), F.when(g % 3 == 0, F.create_map(g, F.lit("ignore"))).alias("actions"))
    return actions.mark_by_hand(members, decisions)


@query(sql("SELECT id, reviewed OR id % 4 = 0 AS reviewed FROM groups_", "groups"))
def mark_reviewed(spark, d):
    groups, _, _ = fx.groups_doc(spark, d)
    return actions.reviewed(groups, groups.filter("id % 4 = 0").select("id")).select("id", "reviewed")


_OUTCOME = "moves AS (SELECT *, CASE WHEN status = 'missing' THEN 'missing' WHEN id % 2 = 0 THEN 'moved' ELSE 'move_failed' END AS outcome FROM files WHERE status NOT IN ('pending', 'deleted'))"


def _log(files):
    outcome = F.when(F.col("status") == "missing", "missing").when(F.col("id") % 2 == 0, "moved").otherwise("move_failed")
    moves = files.filter(~F.col("status").isin("pending", "deleted"))
    return sinks.action_log(moves.select(F.col("id").alias("file_id"), "path", outcome.alias("outcome"), "size", F.lit("busy").alias("error")), _now())


@query(sql("SELECT id AS file_id, path, CASE outcome WHEN 'missing' THEN 'missing' ELSE 'delete' END AS action, outcome = 'moved' AS succeeded, CASE outcome WHEN 'move_failed' THEN 'move_failed: busy' END AS error, CASE outcome WHEN 'moved' THEN size ELSE 0 END AS bytes_freed FROM moves", "files", more=_OUTCOME))
def action_log(spark, d):
    return _log(fx.files_doc(spark, d)).drop("performed_at")


@query(sql("SELECT f.id, CASE m.outcome WHEN 'missing' THEN 'missing' WHEN 'moved' THEN 'deleted' ELSE f.status END AS status FROM files f LEFT JOIN moves m USING (id)", "files", more=_OUTCOME))
def settle_files(spark, d):
    files = fx.files_doc(spark, d)
    return actions.settle(files, _log(files)).select("id", "status")


@query(ORACLE_SQL["effective_action_plan"] + " AND NOT reviewed AND match_type = 'llm' AND similarity >= 0.8")
def auto_delete_llm(spark, d):
    """Proposals from a similarity of 0.8 on, by the keepers that they have."""
    return actions.auto_delete(*fx.groups_doc(spark, d), fx.sources(spark, d), "20240101", ["llm"], threshold=0.8, mark=False)[0]


@query(f"SELECT * FROM ({ORACLE_SQL['settings_latest']}) WHERE starts_with(key, 'p')")
def settings_by_prefix(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("at"), F.col("ts").alias("updated_at"))
    return changes.with_prefix(changes.latest(e, "at"), "p")


@query(sql("SELECT id, path FROM sources WHERE enabled AND path IN (SELECT rtrim(path, '/') FROM sources WHERE id % 2 = 0)", "sources"))
def usable_sources(spark, d):
    known = fx.sources(spark, d)
    return source_table.usable(known, known.filter("id % 2 = 0").select("path")).select("id", "path")


@query(sql("SELECT id, CASE WHEN source_id <> 3 THEN source_id END AS source_id FROM files", "files"))
def source_deleted(spark, d):
    return source_table.delete(fx.sources(spark, d), fx.files_doc(spark, d), 3)[1].select("id", "source_id")


# ---------------------------------------------------------------- text


@query(sql("SELECT id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS bytes, CASE WHEN s = 0 THEN '—' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration, printf('%02d', id % 100) AS shard FROM (SELECT id, size * (id % 13 * 10007 + 1) AS b, size * (id % 5) AS s FROM files)", "files"))
def humanize(spark, d):
    f = fx.files_doc(spark, d).select("id", (F.col("size") * (F.col("id") % 13 * 10007 + 1)).alias("b"), (F.col("size") * (F.col("id") % 5)).alias("s"))
    return f.select("id", kernels.human_bytes("b").alias("bytes"), kernels.human_duration("s").alias("duration"), kernels.shard("id").alias("shard"))


@query(sql("SELECT id, CASE WHEN duration > 0 THEN list_transform(range(0, 16), lambda i: round(greatest(0.5, duration * 0.05) + (greatest(greatest(0.5, duration * 0.05) + 0.5, duration - greatest(0.5, duration * 0.05)) - greatest(0.5, duration * 0.05)) * i / 15, 4)) ELSE [0.0] END AS times FROM files".replace("0.5", "0.5::DOUBLE").replace("0.05::DOUBLE", "0.05::DOUBLE").replace("0.5::DOUBLE::DOUBLE", "0.5::DOUBLE"), "files"))
def frame_times(spark, d):
    return fx.files_doc(spark, d).select("id", F.transform(kernels.frame_times("duration"), lambda t: F.round(t, 4)).alias("times"))


@query(sql("SELECT id, regexp_extract(path, '\\.([^.]*)$', 1) AS extension, CASE WHEN path LIKE '%.mp4' OR path LIKE '%.mkv' THEN 'video' ELSE 'audio' END AS media_type FROM files", "files"))
def classify_paths(spark, d):
    return fx.files_doc(spark, d).select("id", names.extension("path").alias("extension"), names.media_type_of("path").alias("media_type"))


# ---------------------------------------------------------------- all together


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and perceptual groups of the files, keepers marked anew, and what that would free."""
    files = checkpoint(fx.files_doc(spark, sf_dir))
    found = matchers.match_all(files)
    groups = found["exact"].groups.unionByName(found["perceptual"].groups).unionByName(found["chromaprint"].groups)
    members = found["exact"].members.unionByName(found["perceptual"].members).unionByName(found["chromaprint"].members)
    return actions.preview(actions.selected(checkpoint(groups)), checkpoint(members), files).drop("avg_similarity")


_OWN = r"\b(cands|centres|at_|pairs|scored|edges|links|reach|parts_of)\b"
_MATCHED = ",".join([
    _EXACT,
    re.sub(_OWN, r"v_\1", ",".join([_VIDEO.format(without=_OUTSIDE), _WINDOW, _VPAIRS, "edges AS (SELECT a, b FROM scored WHERE score <= 12)", _REACH])),
    re.sub(_OWN, r"a_\1", ",".join([_AUDIO, _WINDOW, _APAIRS, "edges AS (SELECT a, b FROM scored WHERE score >= 0.85)", _REACH])),
    """matched AS (SELECT media_type, 'exact' AS match_type, sha256 AS g, id FROM (SELECT *, count(*) OVER (PARTITION BY media_type, sha256) AS n FROM files WHERE status = 'done' AND sha256 IS NOT NULL) WHERE n > 1
    UNION ALL SELECT 'video', 'perceptual', component::VARCHAR, id FROM v_parts_of UNION ALL SELECT 'audio', 'chromaprint', component::VARCHAR, id FROM a_parts_of),
each AS (SELECT m.media_type, match_type, g, count(*) AS n, sum(size) AS total, max(size) AS largest FROM matched m JOIN files f ON f.id = m.id GROUP BY m.media_type, match_type, g)""",
])


@query(sql(f"SELECT media_type, match_type, {_SUMS} FROM each GROUP BY media_type, match_type", "files", more=_MATCHED))
def match_and_preview(spark, d):
    return flagship(spark, d)
