"""URLs are looked up by all their hosts and folders."""

from weftgraph.llm import url_filter


def test_all_hosts_and_folders_are_looked_up(spark):
    listed = spark.createDataFrame([("http://ads.example.com/",), ("example.org/a/b/c/d/",), ("example.net/x",)], "url string")
    listed = listed.select(url_filter.canonical(listed.url).alias("key"))
    urls = {
        "http://a.b.c.d.e.f.ads.example.com/p/q/r/s/t/u": True,
        "http://m.example.org/a/b/c/d/e/f/g.html": True,
        "http://example.org/a/b/c/d": True,
        "http://example.org/a/b/c/d/?q": True,
        "http://example.org/a/b/c/de": False,
        "http://example.org/a/b/c/": False,
        "http://example.net/x/y": True,
        "http://example.net/xy": False,
        "http://bads.example.com/": False,
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.listed for r in url_filter.judge_urls(pages, [], listed).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())
    raw = spark.createDataFrame([("example.org/a/b/c/d/",)], "key string")  # as listed, with its slash
    got = {r.page_id: r.listed for r in url_filter.judge_urls(pages, [], raw).collect()}
    assert [k for k in got if got[k]] and {k for k in got if got[k]} == {1, 2, 3}
