"""Similarity kernels and scalar functions as column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 64.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def _one_way(a: Column, b: Column) -> Column:
    nearest = F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y)))))
    return F.aggregate(nearest, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(a)


def best_match_distance(a: Column | str, b: Column | str) -> Column:
    """Mean distance of each hash to its nearest in the other sequence, averaged both ways; 64 if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (_one_way(a, b) + _one_way(b, a)) / 2).otherwise(F.lit(FAR))


def whole_distance(a: Column | str, b: Column | str) -> Column:
    return best_match_distance(a, b).cast("int")


def decode_fingerprint(text: Column | str) -> Column:
    """URL-safe base64, padded or not, as bytes."""
    return F.unbase64(F.translate(_col(text), "-_", "+/"))


def byte_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits in the common prefix of two byte strings; 0 without one. Compared 7 bytes at a time."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    word = lambda x, i: F.conv(F.substring(F.hex(F.substr(x, F.lit(1), n)), i * 14 + 1, F.lit(14)), 16, 10).cast("bigint")
    steps = F.sequence(F.lit(0), F.floor((n - 1) / 7).cast("int"))
    differ = F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, i: s + F.bit_count(word(a, i).bitwiseXOR(word(b, i))))
    return F.when(n > 0, 1 - differ / (8 * n)).otherwise(F.lit(0.0))


def fingerprint_similarity(a: Column | str, b: Column | str) -> Column:
    return byte_similarity(decode_fingerprint(a), decode_fingerprint(b))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def content_hash(content: Column | str, size: Column | str, limit: int = 256 << 20, sample: int = 32 << 20) -> Column:
    """SHA-256 of the bytes; above ``limit`` of head, size (8 bytes, big-endian) and tail."""
    content, size = _col(content), _col(size)
    mark = F.unhex(F.lpad(F.hex(size), 16, "0"))
    partial = F.concat(F.substr(content, F.lit(1), F.lit(sample)), mark, F.substr(content, F.greatest(F.length(content) - sample + 1, F.lit(1)), F.lit(sample)))
    return F.when(size <= limit, F.sha2(content, 256)).otherwise(F.sha2(partial, 256))


def frame_times(duration: Column | str, n: int = 16) -> Column:
    """Seconds at which a video is sampled: evenly between paddings of 5 % (half a second at least)."""
    d = _col(duration)
    pad = F.greatest(F.lit(0.5), d * 0.05)
    end = F.greatest(pad + 0.5, d - pad)
    times = F.array((pad + end) / 2) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: pad + (end - pad) * i / (n - 1))
    return F.when(F.coalesce(d, F.lit(0.0)) > 0, times).otherwise(F.array(F.lit(0.0)))


def one_decimal(x: Column | str) -> Column:
    """A number from 0 on with one decimal, as C's printf has it: by the exact value of the double, halves to even. (Java's
    format rounds the shortest decimal form, halves up: 1.25 to 1.3.)"""
    x = _col(x)
    whole = F.floor(x)
    rest = x - whole
    # tenths are the bounds (0.05, 0.15, ...) that the rest has passed; a bound's double may lie above or below it, and on a tie
    # odd tenths go up
    passed = lambda k: rest >= (2 * k + 1) / 20 if (at := Fraction((2 * k + 1) / 20) - Fraction(2 * k + 1, 20)) > 0 or (at == 0 and k % 2) else rest > (2 * k + 1) / 20
    tenths = sum((passed(k).cast("bigint") for k in range(1, 10)), passed(0).cast("bigint"))
    return F.concat((whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(n: Column | str, null: str | None = "—") -> Column:
    """Steps of 1024 up to TB, one decimal but for bytes."""
    n = _col(n).cast("double")
    out = F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (i + 1), F.concat(one_decimal(n / 1024.0**i), F.lit(f" {unit}")))
    return F.when(n.isNull(), F.lit(null)).otherwise(out.otherwise(F.concat(one_decimal(n / 1024.0**4), F.lit(" TB"))))


def human_duration(seconds: Column | str) -> Column:
    s = _col(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(F.coalesce(_col(seconds), F.lit(0.0)) == 0, "—").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def first_line(text: Column | str, most: int = 200) -> Column:
    return F.substring(F.split(F.coalesce(_col(text), F.lit("")), r"\r\n|\r|\n")[0], 1, most)


def shard(file_id: Column | str) -> Column:
    return F.lpad((_col(file_id) % 100).cast("string"), 2, "0")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """The path without its last part; of a path in the root ``/``."""
    p = _col(path)
    up = F.regexp_replace(p, r"/+[^/]*$", "")
    return F.when(~p.contains("/"), "").when(up == "", "/").otherwise(up)


def truthy(text: Column | str) -> Column:
    return F.lower(F.trim(_col(text))).isin("1", "true", "yes", "on")


def duration_bucket(seconds: Column | str) -> Column:
    """Whole seconds, halves to even; nothing is 0."""
    return F.bround(F.coalesce(_col(seconds), F.lit(0.0)), 0).cast("int")
