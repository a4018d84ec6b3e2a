import random

from tidegraph.llm.url_rules import judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "http://a", "http://A.Example.ORG/es/x?q=1#f", "x://example.org?/es/", "http://example.org#/es/",
        "a://b://example.org/en/1", "http://notexample.org/es/", "http://example.org:80/es/", "http://é.ORG/", "http://org", "http://.org/",
        "http://x.com/fr/de/", "http://com/de/", "http://a..com/de/\nx", "http://example.org/en/1" + "1" * 10_000]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'x' AS verdict", "1 AS key", "2 AS salt")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, default=default).collect()}
    assert got == {i: verdict(u, rules, default) for i, u in enumerate(urls)}


def test_awkward_urls(spark):
    check(spark, URLS * 3, RULES)


def test_nested_rules_against_brute_force(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "b", "ab", "a.b"])
    host = lambda: ".".join(word() for _ in range(draw.randint(1, 3)))
    path = lambda: "".join(draw.choice(["/", "a", "b", "/a"]) for _ in range(draw.randint(0, 5)))
    rules = list({(h, "/" + p): draw.choice(["allow", "block"]) for h, p in ((host(), path()) for _ in range(60))}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    check(spark, [f"http://{host()}/{path()}" for _ in range(400)], rules, "block")


def test_no_rules_and_no_pages(spark):
    check(spark, URLS[:5], [])
    check(spark, [], RULES)


check.__test__ = False
