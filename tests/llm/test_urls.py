"""URL verdicts against plain rules and lists, and the filter's rates."""

import random
import re

import pytest
from pyspark.sql import functions as F

from duskwatch.llm import queries, urls

from ..compare import differences, duck

SF = "/root/testdata/sf0.001"
RULES = [*queries.URL_RULES, ("a.example.net", "", "block"), ("example.com", "/de/x", "allow"), ("EXAMPLE.com", "/de/", "block"), ("", "/", "block"), ("com", "de", "block"), (None, "/", "block"), ("org", "/q", None), ("bad/host", "/x", "block")]


def plain(rows, rules, listed):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]

    def name(url):
        if url is None or "://" not in url:
            return None
        h, p = split(url)
        q = url.split("://", 1)[1].split("#")[0].partition("?")[2]
        kept = sorted(x for x in q.split("&") if x and not re.match(urls.TRACKING, x))
        return re.sub(":(80|443)$", "", re.sub("^[^@]*@", "", h)) + p.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    names, out = {name(u) for u in listed} - {None}, []
    for i, url in rows:
        h, p = split(url)
        fit = [(len(a + (b or "")), len(a), v, a + (b or "")) for a, b, v in ((a and a.lower(), b, v) for a, b, v in rules) if a and v and "/" not in a and (not b or b[0] == "/") and (h == a or h.endswith("." + a)) and p.startswith(b or "")]
        hit = name(url) in names and not fit
        out.append((i, h, p, max(fit)[3] if fit else None, max(fit)[2] if fit else "block" if hit else "allow", hit))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


ODD = [
    (1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "http://net"), (6, "http://net/"), (7, "https://A.B.Example.NET/en/1?x#y"), (8, "http://example.net/EN/"), (9, "http://xexample.com/de/"), (10, "http://example.com/de/x?q=1"),
    (11, "ftp://user@www.example.com:443/a/?b=2&a=1&utm_source=z#t"), (12, "http://www.example.com/a?a=1&b=2"), (13, "x://a.example.net?no=path"), (14, "http://example.net./en/"), (15, "http://a://net/"), (16, "http://deep." + "s." * 3000 + "org/fr/" + "p" * 20000),
    (7, "https://A.B.Example.NET/en/1?x#y"), (7, "https://A.B.Example.NET/en/1?x#y"), (None, "http://b.org/fr/"), (None, None), (17, "http://ünï.example.org/fr/é"), (18, "http://..net/"), (19, "//net/"),
]


@pytest.mark.parametrize("most", [10**6, 0])
def test_urls_equal_plain_rules(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", most)
    monkeypatch.setattr(urls, "BROADCAST_ROWS", most)
    rng = random.Random(2)
    hosts = ["example.net", "a.example.net", "b.a.example.net", "example.com", "x.org", "notexample.com", "other.io"]
    rows = ODD + [(100 + k, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'q'])}/{rng.randrange(30)}{rng.choice(['', '/', '?ref=a', '?b=1&a=2', '#f'])}") for k in range(400)]
    listed = ["http://www.example.com/a/?a=1&b=2&ref=q", None, "nothing", *[u for i, u in rows[40:] if i % 3 == 0]]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string").repartition(4)
    got = urls.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in listed], "url string"))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows, RULES, listed), key=key)


def test_url_filter_equals_sql(spark):
    assert differences(queries.op12_url_filter(spark, SF), duck(SF), queries.OP12_SQL) == ""


def test_without_pages_rules_or_list(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge_urls(pages, *none).collect()] == [(1, "net", "/", None, "allow", False)]
    assert urls.judge_urls(pages.limit(0), *none).collect() == []


def test_filter_loses_nothing_and_passes_little_else(spark):
    entries = spark.range(50_000).select(F.concat(F.lit("e"), "id").alias("entry"))
    tried = spark.range(250_000).select(F.concat(F.lit("e"), "id").alias("entry"))
    passed = urls.possible(tried, entries, 50_000).count()
    assert 50_000 <= passed <= 50_000 + 200_000 * 0.002
