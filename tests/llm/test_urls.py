from __future__ import annotations

import random

import pytest

from tidemark.llm import urls

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("WWW.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/es/", "allow"),
    ("org", "", "block"),
    ("a.org", "/p", "allow"),
    (None, "/", "block"),
    ("", "/", "block"),
    ("x.net", None, "block"),
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER))
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if not h:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(filter(None, (best, (len(h + p), len(h), h + p, v))))
    return (host, path, best[2] if best else None, best[3] if best else default)


def sample():
    draw = random.Random(4)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "net", "x.net", "a.org", "b.a.org", "org", "com", "é.com", "u@h.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/es/1", "/p", "/px?q=/en/", "#/en/", "/en/#x", "?a", "/a\nb"]
    made = [f"{draw.choice(['http', 'HTTPS', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(300)]
    return made + [None, "", "no scheme", "://", "a://b://c/en/", made[0]]


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_matches_brute_force(spark, limit):
    listed = sample()
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(listed)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge_urls(pages, rules, broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect())) == [(i, *brute(u, RULES)) for i, u in enumerate(listed)]


def test_filter_lets_every_listed_key_pass(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '.com/') as key")
    bloom = urls.bloom_blocks(keys, "key", 313)
    assert urls.possible_hits(keys, "key", bloom, 313).count() == 5000
    others = spark.range(5000).selectExpr("concat('other', id, '.com/') as key")
    assert urls.possible_hits(others, "key", bloom, 313).count() < 250


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    got = urls.judge_urls(pages, none).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(1, "a.com", "/", None, "allow"), (None, "", "", None, "allow")}
    rules = spark.createDataFrame(RULES, none.schema)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
