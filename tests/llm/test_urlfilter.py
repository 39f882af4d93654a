from glyphmill.llm import common as K
from glyphmill.llm import urlfilter as U


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(str.maketrans(K.UPPER, K.LOWER))
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    "https://a.Example.NET/en/1", "http://example.net/EN/2", "https://x.org/fr/", "https://x.org/fr", "http://net/", "http://net", "ftp://sub.net:80/x", "http://mynet/", None, "", "nothing", "http://example.com/de/x?y#z", "http://b.example.com/de?x",
    "http://example.com#/de/", "://org/fr/a", "http://a://b.net/c", "https://..net/x", "https://é.NET/x/", "http://example.net/en/" + "x" * 20000,
]


def check(spark, rules, urls=URLS, **more):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **more).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_rules(spark):
    check(spark, U.RULES)


def test_hosts_of_many_labels(spark):
    """A host costs what the list has, not what it has itself."""
    long = "a." * 100_000
    check(spark, [*U.RULES, ("x.y.example.org", "/p", "block")], [f"http://{long}example.org/fr/x", f"http://{long}x.y.example.org/p1", f"http://{long}com/de/", "http://y.example.org/p", "http://.org/fr/", "http://org./fr/"])


def test_shuffled_join(spark):
    check(spark, U.RULES, broadcast_rows=0)


def test_many_entries(spark):
    check(spark, [*U.RULES, *((f"h{i}.org", f"/p{i}/", "block") for i in range(800))], [*URLS, *(f"http://h{i}.org/p{i}/x" for i in range(0, 900, 7)), *(f"http://h{i}.org/q/" for i in range(0, 900, 11))])


def test_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.judge(pages, none).collect()] == [(None, "allow")] * 2
    assert U.judge(pages.limit(0), spark.createDataFrame(U.RULES, "host string, path string, verdict string")).count() == 0
