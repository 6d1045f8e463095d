"""URL filters by Empirical-Bayes host reputation.

Page outcomes that are already known (here: those a curated rule decides) are shrunk through
beta-binomial priors, host -> registered domain -> suffix -> all pages; a page that no rule fits is
blocked when the upper posterior bound of its host's rate of good outcomes stays below a half.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Standard deviations above the posterior mean, and the rate that the bound must stay below.
Z, CUT = 1.645, 0.5
#: Bounds of a prior's strength in pages, and the strength where outcomes can't tell.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 1000.0, 10.0

#: Public suffixes of several labels; any other host ends in a suffix of one label.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.uk",
)
#: Addresses, which are domains of their own under a suffix that no host has.
_ADDRESS, _ADDRESSES = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])\z", "#"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what: str = "text") -> Column:
    """Of the rules that fit, the longest one's text (or verdict); null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(getattr(r, what)))
        for r in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _patterns(suffixes: Sequence[str]) -> tuple[str, str]:
    """What extracts a host's registered domain (a suffix and one label more), and its suffix."""
    several = "".join(s.replace(".", r"\.") + "|" for s in suffixes)
    return rf"(?:^|\.)([^.]+\.(?:{several}[^.]+))\z", rf"(?:^|\.)((?:{several}[^.]*))\z"


def _strength(n: Column, y: Column, mean: Column) -> Column:
    """A beta prior's strength from its groups' counts round the means of their parents, by the moments of
    the beta-binomial."""
    groups = F.count("*")
    off = y - n * mean
    over = F.sum(off * off / (n * mean * (1 - mean))) - groups
    room = F.sum(n) - groups
    bounded = F.least(F.greatest((room - over) / over, F.lit(WEAKEST)), F.lit(STRONGEST))
    return F.when((room > 0) & (over > 0), bounded).otherwise(UNKNOWN)


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host's rate of good outcomes.

    ``outcomes``: host, n (labelled pages), y (good ones), a row for each host, n = 0 allowed.
    Returns host, n, y, rate (posterior mean) and upper (its bound). ``suffixes`` are the public ones of
    several labels; an address is its own domain. The driver gets four numbers.
    """
    domain, suffix = _patterns(suffixes)
    address = F.col("host").rlike(_ADDRESS)
    hosts = outcomes.select(
        "host",
        F.when(~address & F.col("host").rlike(domain), F.regexp_extract("host", domain, 1)).otherwise(F.col("host")).alias("domain"),
        F.when(address, _ADDRESSES).otherwise(F.regexp_extract("host", suffix, 1)).alias("suffix"),
        F.col("n").cast("double"),
        F.col("y").cast("double"),
    )
    hosts = checkpoint(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("y").alias("dy"))
    ends = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dy").alias("sy"))
    top = ends.agg(((F.coalesce(F.sum("sy"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("sn"), F.lit(0.0)) + 1)).alias("m")).first()
    m = F.lit(top["m"])
    strength = lambda t, n, y, mean: t.filter(F.col(n) > 0).agg(_strength(F.col(n), F.col(y), mean).alias("k")).first()["k"]
    ks = strength(ends, "sn", "sy", m)
    domains = domains.join(ends.select("suffix", ((F.col("sy") + ks * m) / (F.col("sn") + ks)).alias("sm")), "suffix")
    kd = strength(domains, "dn", "dy", F.col("sm"))
    hosts = hosts.join(domains.select("domain", ((F.col("dy") + kd * F.col("sm")) / (F.col("dn") + kd)).alias("dm")), "domain")
    kh = strength(hosts, "n", "y", F.col("dm"))
    a = F.col("y") + kh * F.col("dm")
    b = F.col("n") - F.col("y") + kh * (1 - F.col("dm"))
    return (
        hosts.select("host", "n", "y", a.alias("a"), b.alias("b"))
        .withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn("upper", F.col("rate") + Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("a") + F.col("b") + 1)))
        .select("host", "n", "y", "rate", "upper")
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every page with host, path, fitting rule, verdict and the host's posterior.

    A null url, or one without ``://``, has an empty host and path; those pages share the
    reputation of the empty host, which no rule fits. Repeated pages count as often as they occur.
    Without any known outcome everything is allowed. Other columns of ``pages`` are not read.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumns(
        {
            "rule": rule_of(F.col("host"), F.col("path"), rules),
            "ruled": rule_of(F.col("host"), F.col("path"), rules, "verdict"),
            "site": F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""),
        }
    )
    outcomes = judged.groupBy(F.col("site").alias("host")).agg(
        F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("y")
    )
    known = host_reputation(outcomes).select(F.col("host").alias("site"), "rate", "upper")
    return judged.join(known, "site", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("upper") < CUT, "block").otherwise("allow")).alias("verdict"),
        F.round("rate", 6).alias("host_rate"),
        F.round("upper", 6).alias("host_upper"),
    )


def op1_sql(rules: Sequence[Rule] = RULES, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The same in DuckDB SQL."""
    domain, suffix = _patterns(suffixes)
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{getattr(r, what)}'" for r in ordered) + " END"

    def k(n: str, y: str, mean: str, t: str) -> str:
        return f"""(SELECT CASE WHEN room > 0 AND over_ > 0 THEN least(greatest((room - over_) / over_, {WEAKEST}), {STRONGEST}) ELSE {UNKNOWN} END FROM (
            SELECT sum(({y} - {n} * {mean}) * ({y} - {n} * {mean}) / ({n} * {mean} * (1 - {mean}))) - count(*) AS over_, sum({n}) - count(*) AS room
            FROM {t} WHERE {n} > 0))"""

    return f"""
    WITH parts AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    hosted AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, path FROM parts),
    judged AS (SELECT *, {case("text")} AS rule, {case("verdict")} AS ruled,
                      regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM hosted),
    hosts AS (SELECT site, CASE WHEN NOT regexp_matches(site, '{_ADDRESS}') AND regexp_matches(site, '{domain}') THEN regexp_extract(site, '{domain}', 1) ELSE site END AS domain,
                     CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN '{_ADDRESSES}' ELSE regexp_extract(site, '{suffix}', 1) END AS suffix, count(ruled)::DOUBLE AS n,
                     count(*) FILTER (ruled = 'allow')::DOUBLE AS y FROM judged GROUP BY site),
    domains AS (SELECT domain, suffix, sum(n) AS dn, sum(y) AS dy FROM hosts GROUP BY domain, suffix),
    suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dy) AS sy FROM domains GROUP BY suffix),
    top AS (SELECT (coalesce(sum(sy), 0) + 0.5) / (coalesce(sum(sn), 0) + 1) AS m FROM suffixes),
    ks AS (SELECT {k("sn", "sy", "m", "suffixes, top")} AS ks),
    sm AS (SELECT suffix, (sy + ks * m) / (sn + ks) AS sm FROM suffixes, ks, top),
    ds AS (SELECT * FROM domains JOIN sm USING (suffix)),
    kd AS (SELECT {k("dn", "dy", "sm", "ds")} AS kd),
    dm AS (SELECT domain, (dy + kd * sm) / (dn + kd) AS dm FROM ds, kd),
    hs AS (SELECT site, n, y, dm FROM hosts JOIN dm USING (domain)),
    kh AS (SELECT {k("n", "y", "dm", "hs")} AS kh),
    ab AS (SELECT site, y + kh * dm AS a, n - y + kh * (1 - dm) AS b FROM hs, kh),
    known AS (SELECT site, a / (a + b) AS rate, a / (a + b) + {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper_ FROM ab)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN upper_ < {CUT} THEN 'block' ELSE 'allow' END) AS verdict,
           round(rate, 6) AS host_rate, round(upper_, 6) AS host_upper
    FROM judged LEFT JOIN known USING (site)
    """
