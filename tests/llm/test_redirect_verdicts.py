from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from casemesh.llm import redirect_verdicts as R
from casemesh.llm.queries import URL_RULES as RULES

URLS = [None, "", "no scheme", "http://", "http://Example.NET/en/1", "https://a.example.net/de/1", "http://x.org/fr/2",
        "http://x.org/en/2", "http://x.example.com/de/3", "http://x.example.com/de", "http://x.example.com/de/", "http://notnet/x",
        "http://net/", "http://net", "http://b.net?q=/en/", "ftp://b.net#x", "http://a.b/c?u=http://d.net/", "http://c.org/a.html",
        "http://c.org/a/", "http://c.org/a?utm_source=x#top", "http://c.org/a?page=2&ref=x", "x://y://z/w", "http://e.net:80/en/"]


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]


def slow_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, verdict string").repartition(3)


def judged(spark, rows, **more):
    got = R.judge_pages(pages(spark, [(*r, "h", "r", "v") for r in rows]), RULES, **more).collect()
    assert len(got) == len(rows)
    return sorted(map(tuple, got), key=repr)


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [(i, u, None) for i, u in enumerate(URLS)])
    for i, host, path, rule, verdict in got:
        assert (host, path) == slow_host_path(URLS[i])
        fits = slow_rule(host, path)
        assert rule == (fits.host + fits.path if fits else None)
        assert not fits or verdict == fits.verdict


def link(target):
    return f"<html><head><LINK href='{target}' Rel=canonical></head></html>"


def refresh(target):
    return f'<meta http-equiv="Refresh" content="0; URL={target}">'


def test_verdicts_follow_links_and_allow_wins(spark):
    rows = [(1, "http://a.org/x", link("http://b.org/y")), (2, "http://b.org/y.html", refresh("https://evil.net/z")),
            (3, "http://c.org/x", link("http://b.org/y#frag")),                       # a - b - c reach a blocked host
            (4, "http://d.org/x", link("/y")), (5, "http://d.org/y/", link("http://s.example.com/de/1")),
            (6, "http://d.org/y?utm_source=q", link("//t.org/fr/9")),                 # blocked and allowed: allowed
            (7, "http://lone.org/", None), (8, None, link("http://evil.net/")), (9, "http://evil.net/z", ""),
            (10, "http://a.org/x?page=2", None), (10, "http://a.org/x?page=2", None), (11, "http://r.org/p", "<link rel=canonical>")]
    said = [(r[0], r[4]) for r in judged(spark, rows)]
    assert sorted(said) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"),
                            (8, "allow"), (9, "block"), (10, "allow"), (10, "allow"), (11, "allow")]
    more = spark.createDataFrame([("http://lone.org", "http://net/"), (None, "http://x.y"), ("http://r.org/p", None)], "source string, target string")
    assert (7, "block") in [(r[0], r[4]) for r in judged(spark, rows, redirects=more)]


def test_a_long_chain_and_a_hub(spark):
    rows = [(i, f"http://h{i}.org/p", link(f"http://h{i + 1}.org/p")) for i in range(40)]
    rows += [(100 + i, f"http://s{i}.org/p", link("http://hub.org/")) for i in range(60)] + [(300, "http://hub.org/", refresh("http://h3.org/p"))]
    assert {r[4] for r in judged(spark, rows)} == {"allow"}
    assert {r[4] for r in judged(spark, [*rows, (400, "http://h40.org/p", link("http://bad.net/"))])} == {"block"}


def test_empty(spark):
    assert judged(spark, []) == []


@pytest.mark.parametrize("url", ["http://c.org/a.html", "https://C.org/a/", "http://c.org/a?utm_source=x#top", "http://c.org/a?ref=1"])
def test_plain_address(spark, url):
    assert spark.range(1).select(R.plain_address(F.lit(url))).first()[0] == "c.org/a"
    assert urlsplit(url).hostname == "c.org"
