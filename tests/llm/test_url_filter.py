from tests.llm import brute

from strandlake.llm import url_filter

URLS = [
    None, "", "nothing", "http://a.org/x", "HTTP://ORG/", "https://Example.ORG/es/1?a=1#b", "http://www.example.org/en/17", "http://example.org/en/2",
    "http://x.example.com/fr/9", "http://com/de/", "http://xcom/de/1", "http://a.com/de", "http://a.org", "http://a.org?x=1", "http://b.net/é/ü?q=1&r=2",
    "ftp://K\u212a.org/p#://x", "a://b://c.org/d",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute.url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://site{i % 7}.com/{'fr' if i % 2 else 'de'}/{'a' * 3 if i % 2 else '123456789'}") for i in range(200)]
    rows += [(1000 + i, f"http://site{i}.net/xx/{'aaa' if i % 2 else '987654321'}") for i in range(40)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum((got[1000 + i].verdict == "block") == (i % 2 == 0) for i in range(40))
    assert right >= 36 and all(got[1000 + i].rule is None for i in range(40))


def test_nothing_to_learn_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert [(r.verdict, r.score) for r in url_filter.judge(pages).collect()] == [("allow", None)] * 2
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_a_url_with_most_copies_does_not_fill_the_sample(spark):
    rows = [(i, f"http://site{i % 7}.com/{'fr' if i % 2 else 'de'}/{'a' * (3 + i % 5) if i % 2 else '1234' + str(i)}") for i in range(120)]
    rows += [(1000 + i, f"http://site{i}.net/xx/{'aaaa' if i % 2 else '98765432'}") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    for hot in ("http://hot.com/fr/abc", "http://hot.com/de/12345678"):
        copies = spark.range(6000).selectExpr("2000 + id as page_id", f"'{hot}' as url")
        got = {r.page_id: r for r in url_filter.judge(frame.union(copies), training_rows=60).collect()}
        right = sum((got[1000 + i].verdict == "block") == (i % 2 == 0) for i in range(40))
        assert right >= 36 and all(got[1000 + i].score is not None for i in range(40))
