from calorway.llm.queries import URL_RULES
from calorway.llm.url_filters import judge_feed_urls

URLS = ["https://data.example.com/en/a?b", "HTTP://WWW.Example.COM/en/", "http://x.www.example.com/en/1", "http://notexample.com/en/", "http://a.net/es/x",
        "http://a.net/ES/x", "http://a.net", "http://com/", "no scheme", "", None, "http://a.net/fr/#top", "http://a.net/fr/#top", "ftp://b.org/fr/", "://example.com/en/://x"]


def brute(url, rules):
    url = url or ""
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_equals_brute_force(spark):
    rules = URL_RULES + [("example.com", "/en/a", "allow"), ("net", "/e", "block")]
    feeds = spark.createDataFrame([(k if k else None, u, "h") for k, u in enumerate(URLS)], "dataset_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (100, 0):
        got = [tuple(r)[1:] for r in judge_feed_urls(feeds, table, broadcast_rules=most).collect()]
        assert sorted(got, key=str) == sorted([(u, *brute(u, rules)) for u in URLS], key=str)


def test_no_rules_and_no_feeds(spark):
    feeds = spark.createDataFrame([(1, "http://a.com/")], "dataset_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert judge_feed_urls(feeds, none).first()["verdict"] == "allow"
    assert judge_feed_urls(feeds.limit(0), none).count() == 0
