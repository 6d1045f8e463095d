"""File names: resolution, identity key and content tokens, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.kernels import _col, basename

# Resolution names and their ranks.
RESOLUTIONS = {
    "4320p": 4320,
    "8k": 4320,
    "2160p": 2160,
    "4k": 2160,
    "uhd": 2160,
    "1440p": 1440,
    "2k": 1440,
    "qhd": 1440,
    "1080p": 1080,
    "fhd": 1080,
    "720p": 720,
    "hd": 720,
    "576p": 576,
    "540p": 540,
    "480p": 480,
    "sd": 480,
    "360p": 360,
    "240p": 240,
}
# Tokens that say nothing about the content.
NOISE = (
    "mp4", "mkv", "avi", "mov", "webm", "wmv", "flv", "m4v", "ts",
    "h264", "h265", "x264", "x265", "hevc", "avc", "aac", "mp3",
    "web", "webdl", "web-dl", "webrip", "bluray", "brrip", "bdrip",
    "hdtv", "dvdrip", "remux",
    "xxx", "rip", "siterip", "complete", "uncensored", "censored",
    "remastered", "extended", "directors", "cut",
)
# Words that content tokens leave out.
STOPWORDS = (
    "and", "the", "with", "of", "in", "on", "a", "an", "to", "for",
    "from", "by", "feat", "ft", "vs", "or", "her", "his", "him", "she",
    "he", "it", "they", "this", "that", "those", "these",
)
# Extensions by kind.
VIDEO_EXTENSIONS = (
    "mp4", "mkv", "avi", "mov", "wmv", "flv", "webm",
    "m4v", "mpeg", "mpg", "ts", "m2ts", "vob", "3gp",
    "asf", "rm", "rmvb", "divx", "f4v", "ogv",
)
AUDIO_EXTENSIONS = (
    "mp3", "flac", "m4a", "aac", "ogg", "oga", "opus",
    "wav", "wma", "alac", "ape", "aiff", "aif", "dsf",
    "dff", "mka", "wv",
)

_RESOLUTION = "(?i)(?<![a-z0-9])(" + "|".join(RESOLUTIONS) + ")(?![a-z0-9])"


def resolution_label(path: Column | str) -> Column:
    """The first resolution named anywhere in the path, lower case; null if none."""
    found = F.lower(F.regexp_extract(_col(path), _RESOLUTION, 1))
    return F.when(found != "", found)


def resolution_rank(path: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in RESOLUTIONS.items() for x in pair])
    return F.coalesce(ranks[resolution_label(path)], F.lit(0))


def stem(path: Column | str) -> Column:
    """Last part of the path without its extension; leading dots don't start one."""
    return F.regexp_replace(basename(path), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*\.([^.]*)$", 1))


def media_type_of(path: Column | str) -> Column:
    return F.when(extension(path).isin(*VIDEO_EXTENSIONS), "video").otherwise("audio")


def extensions_for(media_type: str) -> tuple[str, ...]:
    return {"video": VIDEO_EXTENSIONS, "audio": AUDIO_EXTENSIONS}.get(media_type, VIDEO_EXTENSIONS + AUDIO_EXTENSIONS)


def name_tokens(path: Column | str) -> Column:
    """The name's tokens in order: brackets, a release tag at the end, resolutions and noise are left
    out, and numbers of one or two digits unless three or more stand in a row (a date)."""
    x = F.lower(stem(path))
    x = F.regexp_replace(x, r"[\[({][^\])}]*[\])}]", " ")
    x = F.regexp_replace(x, r"-[a-z0-9]{2,15}(?:\[[a-z0-9]{2,10}\])?\z", "")
    x = F.regexp_replace(x, _RESOLUTION, " ")
    x = F.regexp_replace(x, r"[._-]+", " ")
    tokens = F.filter(F.split(x, r"\s+"), lambda t: (t != "") & ~t.isin(*NOISE))
    return _once(tokens, lambda ts: _once(F.transform(ts, lambda t: t.rlike(r"^[0-9]{1,2}$")), lambda short: _undated(ts, short)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, not wherever and for each element that ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _undated(tokens: Column, short: Column) -> Column:
    """``tokens`` without the ``short`` ones outside dates."""
    at = lambda i: F.coalesce(F.get(short, i), F.lit(False))
    dated = lambda i: (at(i - 2) & at(i - 1)) | (at(i - 1) & at(i + 1)) | (at(i + 1) & at(i + 2))
    return F.filter(tokens, lambda t, i: ~at(i) | dated(i))


def name_key(path: Column | str) -> Column:
    """Files with equal keys are taken to be the same content."""
    return F.array_join(name_tokens(path), " ")


def content_tokens(path: Column | str) -> Column:
    """The key's tokens as a set, without stopwords."""
    return F.array_except(name_tokens(path), F.array(*[F.lit(w) for w in STOPWORDS]))
