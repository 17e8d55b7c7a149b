from threadline.llm import url_filter
from threadline.llm.queries import RULES
from tools.compare import check, connect

SCHEMA = "page_id long, url string, host string, verdict int, text string"


def judged(spark, urls):
    frame = spark.createDataFrame([(i, u, "h", 1, "t") for i, u in enumerate(urls)], SCHEMA)
    return [url_filter.filter_urls(frame, RULES), urls]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/en": ("example.net", "/en", "net/", "block"),
        "https://example.net": ("example.net", "", None, None), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "x://example.com/de/?a": ("example.com", "/de/", "example.com/de/", "block"), "ftp://b.org/fr/a://b": ("b.org", "/fr/a://b", "org/fr/", "allow"),
        "org/fr/": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "http://ÄB.org?x/fr/": ("Äb.org", "", None, None),
        "http://h.org\n/fr/": ("h.org\n", "/fr/", None, None),
    }
    frame, urls = judged(spark, list(cases))
    found = {r.url: r for r in frame.collect()}
    assert len(found) == len(urls)
    for url, (host, path, rule, verdict) in cases.items():
        r = found[url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_model_separates_what_rules_separate(spark):
    good = [f"http://good{i}.org/fr/article/{i}" for i in range(150)]
    bad = [f"http://bad{i}.net/buy/cheap{i}" for i in range(150)]
    new_good = [f"http://good{i}.com/fr/article/{i}" for i in range(150, 190)]
    new_bad = [f"http://bad{i}.com/buy/cheap{i}" for i in range(150, 190)]
    frame, _ = judged(spark, (good + bad + new_good + new_bad) * 2)
    verdicts = {r.url: r.verdict for r in frame.collect()}
    assert frame.count() == 2 * 380
    assert sum(verdicts[u] == "allow" for u in new_good) >= 38 and sum(verdicts[u] == "block" for u in new_bad) >= 38


def test_one_class_or_none(spark):
    frame, _ = judged(spark, ["http://a.net/x", "http://b.com/y", None, "z" * 20_000])
    assert {r.url: r.verdict for r in frame.collect()} == {
        "http://a.net/x": "block", "http://b.com/y": "allow", None: "allow", "z" * 20_000: "allow"
    }
    assert url_filter.filter_urls(frame.limit(0).select("page_id", "url"), RULES).count() == 0


def test_twin(spark, data):
    status, _, note = check(spark, connect(data), data, "op9_url_filter")
    assert status == "ok", note
