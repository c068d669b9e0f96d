from foliant.llm.queries import URL_LABELS, URL_RULES
from foliant.llm.url_filters import Rule, filter_urls, host_path, label
from tests.llm.oracle import compare


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op8_url_filter") == spark.read.parquet(f"{sf}/pages.parquet").count()


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    stop = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop] if stop > end else ""


def expected(url):
    host, path = brute(url)
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = sorted(x for x in URL_LABELS if x in host.split("."))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2] or ("block" if labels else "allow"), f"label {labels[0]}" if labels else None


def test_odd_urls(spark):
    urls = ["http://A.Example.COM/en/77?x=1", "http://example.com/en/8", "https://com/en/", "https://com/en", "https://xcom/en/1", "ftp://a.example.net/de/80#t", "http://net/de/", "http://example.net/de/8",
            "http://x.org/es/", "http://org/es/9?/", None, "", "no scheme.com/en/7", "://com/en/1", "http://", "http://?q", "http://com?/en/", "http://com:80/en/", "http://u@com/en/", "a://b://com/en/",
            "http://ÄB.Com/en/x\ny", "http://www.spam-farm.example.org/es/1", "http://spam-farm", "http://spam-farms.com/fr/", "http://cheap-pills.spam-farm.net/de/1", "http://com//en/", "http://com/EN/", "http://.com/en/", "http://com./en/",
            "http://x.com/" + "a/" * 20000, "http://example.com/en/7\n"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://a.com/en/1", "h"), (3, "http://a.com/en/1", "h"), (3, "http://a.com/en/1", "h")]
    rules = [host_path(*r) for r in URL_RULES] + [label("block", x) for x in URL_LABELS]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *expected(u))) for i, u, _ in rows)


def test_general_rules(spark):
    """Rules without tokens are tried on every URL; a host rule without a path ends at the host's end; ties go by name."""
    rules = [Rule("digits", "block", r"/\d+\z", rank=1), Rule("a", "allow", "x", rank=1), host_path("allow", "b.com", "")]
    pages = spark.createDataFrame([(1, "http://x.com/12"), (2, "http://y.com/12"), (3, "http://a.b.com/12"), (4, "http://bb.com/"), (5, "http://b.com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in filter_urls(pages, rules, default="review").collect()}
    assert got == {1: (None, "allow", "a"), 2: (None, "block", "digits"), 3: ("b.com", "allow", "digits"), 4: (None, "review", None), 5: ("b.com", "allow", None)}
    assert {r.verdict for r in filter_urls(pages, []).collect()} == {"allow"}


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), [label("block", "x")]).collect() == []
