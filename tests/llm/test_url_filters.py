import math
from collections import defaultdict

import pytest

from twinsift.llm import url_filters as u

URLS = [
    "https://Blog.A.example.ORG/es/1?x#y", "http://a.example.org/en/1", "http://a.example.org/en/2", "http://example.org", "http://example.org?q", "http://xexample.org/es/",
    "https://x.com/fr/1", "https://x.com/fr/2", "https://bad.com/de/1", "https://bad.com/de/2", "https://bad.com/de/3", "https://bad.com/en/1", "https://x.com/en/", "https://user@x.com:80/en/",
    "http://10.0.0.1/x", "http://10.0.1.1/fr/", "https://a.co.uk/x", "https://shop.b.co.uk:8080/x", "https://co.uk/x", "https://a.com.au/fr/",
    "ftp://net", "no scheme", None, "://", "http:///path", "a://b://c/d", "https://ÄB.com/fr/ü",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:i], rest[i:]
    j = next((k for k, c in enumerate(rest) if c in "?#"), len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:j]


def rule(host, path):
    fit = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def strength(groups, parent):
    groups = [(n, y, parent(k)) for k, (n, y) in groups.items() if n]
    over = sum((y - n * m) ** 2 / (n * m * (1 - m)) for n, y, m in groups) - len(groups)
    room = sum(n for n, _, _ in groups) - len(groups)
    if room <= 0 or over <= 0:
        return u.UNKNOWN
    return min(max((1 - over / room) / (over / room), u.WEAKEST), u.STRONGEST)


def test_against_plain_python(spark):
    urls = URLS + [f"https://h{i % 7}.site{i % 3}.com/{'fr' if (i * 7) % 5 < 2 else 'de' if i % 3 == 2 else 'en'}/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in u.judge(df).collect()}
    assert len(got) == len(urls)
    hosts = defaultdict(lambda: [0, 0])
    for url in urls:
        host, path = split(url)
        site = host.rsplit("@", 1)[-1]
        site = site[: site.rindex(":")] if ":" in site and site.rsplit(":", 1)[1].isdigit() else site
        r = rule(host, path)
        hosts[site][0] += r is not None
        hosts[site][1] += r is not None and r.verdict == "allow"
    address = lambda s: s.count(".") == 3 and s.replace(".", "").isdigit()
    suffix = lambda s: "#" if address(s) else ".".join(s.split(".")[-2:]) if ".".join(s.split(".")[-2:]) in u.SUFFIXES else s.split(".")[-1]

    def domain(s):
        labels = s.split(".")[-1 - len(suffix(s).split(".")) :]
        return s if address(s) or len(labels) < 2 or not all(labels) else ".".join(labels)

    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for s, (n, y) in hosts.items():
        for t, k in ((domains, domain(s)), (suffixes, suffix(s))):
            t[k][0] += n
            t[k][1] += y
    m = (sum(y for _, y in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)
    mean = lambda t, k, strong, m: (t[k][1] + strong * m) / (t[k][0] + strong)
    ks = strength(suffixes, lambda s: m)
    kd = strength(domains, lambda d: mean(suffixes, suffix(d), ks, m))
    of_domain = lambda s: mean(domains, domain(s), kd, mean(suffixes, suffix(s), ks, m))
    kh = strength(hosts, of_domain)
    for i, url in enumerate(urls):
        host, path = split(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path), url
        r = rule(host, path)
        assert got[i]["rule"] == (r.text if r else None), url
        if r:
            assert got[i]["verdict"] == r.verdict
            continue
        site = host.rsplit("@", 1)[-1]
        site = site[: site.rindex(":")] if ":" in site and site.rsplit(":", 1)[1].isdigit() else site
        dm = of_domain(site)
        n, y = hosts[site]
        a, b = y + kh * dm, n - y + kh * (1 - dm)
        upper = a / (a + b) + u.Z * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
        assert got[i]["host_upper"] == pytest.approx(upper, abs=1e-5), url
        assert got[i]["verdict"] == ("block" if upper < u.CUT else "allow")
    assert got[11]["verdict"] == "block"  # bad.com has only bad outcomes
    assert [domain(h) for h in ("x.a.co.uk", "co.uk", "10.0.0.1", "b.c.com")] == ["a.co.uk", "co.uk", "10.0.0.1", "c.com"]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.b/", "y")], "page_id long, url string, host string")
    assert u.judge(df).count() == 3
    assert u.judge(df.limit(0)).count() == 0
    assert {r["rule"] for r in u.judge(df, rules=()).collect()} == {None}
