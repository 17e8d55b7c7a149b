import datetime as dt

from pyspark.sql import functions as F

from threadline.llm import warc_revisits as warc
from tools.compare import check, connect

SCHEMA = "record_id string, record_type string, target_uri string, date timestamp, http_headers string, payload string, key string, stored int"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def full(name, url, minute, headers, payload="body", status=200):
    return (name, "response", url, minute if minute is None else at(minute), f"HTTP/1.1 {status} X\r\n{headers}\r\n\r\n", payload, "k", 1)


def again(name, url, minute, headers):
    return (name, "revisit", url, minute if minute is None else at(minute), f"HTTP/1.1 304 Not Modified\r\n{headers}\r\n\r\n", None, "k", 1)


def resolved(spark, rows):
    return {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_outcomes(spark):
    url = "https://www.Example.com:443/a/?b=2&a=1#x"
    rows = [
        full("r1", url, 1, 'ETag: "one"\r\nContent-Length: 4\r\nCache-Control: old\r\nX-Keep: yes\r\nbroken line'),
        full("r2", "http://example.com/a?a=1&b=2", 5, 'ETag: W/"two"\r\nLast-Modified: then', "second"),
        full("r3", url, 6, 'ETag: "gone"', status=404),
        again("v0", url, 1, 'ETag: "one"'),  # not earlier than itself
        again("v1", url, 3, 'ETag: W/"one"\r\nCache-Control: new\r\nContent-Length: 0'),
        again("v2", url, 7, 'ETag: "two"'), again("v3", url, 8, 'ETag: "three"\r\nLast-Modified: then'),
        again("v4", url, 9, "Last-Modified: then"), again("v5", url, 9, "X: y"),
        again("v6", "http://other.org/", 9, 'ETag: "one"'), again("v7", None, 9, 'ETag: "one"'), again("v8", url, None, 'ETag: "one"'),
        ("m1", "metadata", url, at(2), None, None, "k", 1), (None, None, None, None, None, None, None, None),
    ]
    found = resolved(spark, rows)
    assert {k: r.outcome for k, r in found.items()} == {
        "v0": "orphan", "v1": "resolved", "v2": "resolved", "v3": "changed", "v4": "resolved", "v5": "unverified",
        "v6": "orphan", "v7": "orphan", "v8": "orphan",
    }
    assert found["v1"].refers_to == "r1" and found["v2"].refers_to == "r2" and found["v2"].payload == "second"
    headers = [tuple(h) for h in found["v1"].headers]
    assert headers == [("content-length", "4"), ("x-keep", "yes"), ("etag", 'W/"one"'), ("cache-control", "new")]
    assert found["v3"].payload is None and found["v3"].headers is None


def test_hot_url_over_many_slices(spark):
    rows = [full(f"r{i:04}", "http://hot.org/", 10 * i, f'ETag: "{i}"', f"p{i}") for i in range(200)]
    rows += [again(f"v{i:04}", "http://hot.org/", 10 * i + 5, f'ETag: "{i}"') for i in range(200)]
    rows += rows[:3]  # repeated responses count once
    found = resolved(spark, rows)
    assert len(found) == 200
    assert all(r.outcome == "resolved" and r.payload == f"p{int(k[1:])}" for k, r in found.items())


def test_null_and_repeated_ids(spark):
    rows = [full("r1", "http://a.org/", 1, 'ETag: "a"', "old"), full(None, "http://a.org/", 2, 'ETag: "a"', "new")]
    rows += [full(None, "http://b.org/", 1, 'ETag: "b"', "other")]
    rows += [again(None, "http://a.org/", 5, 'ETag: "a"'), again(None, "http://b.org/", 5, 'ETag: "b"')]
    rows += [again("v", "http://a.org/", 6, 'ETag: "a"'), again("v", "http://b.org/", 6, 'ETag: "b"'), again("v", "http://c.org/", 6, "")]
    found = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.record_id or "", r.url_key, r.outcome, r.payload or "") for r in found) == [
        ("", "a.org", "resolved", "new"), ("", "b.org", "resolved", "other"),
        ("v", "a.org", "resolved", "new"), ("v", "b.org", "resolved", "other"), ("v", "c.org", "orphan", ""),
    ]


def test_empty(spark):
    assert resolved(spark, []) == {}


def test_canonical_url(spark):
    urls = ["HTTP://WWW.A.com:80/x//?#f", "a.com/x", "a.com/X", "", None, "a.com?z&&b", "http://a.com:8080/"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in frame.collect()] == ["a.com/x", "a.com/x", "a.com/X", "", None, "a.com?b&z", "a.com:8080"]


def test_twin(spark, data):
    status, _, note = check(spark, connect(data), data, "op7_warc_revisits")
    assert status == "ok", note


def test_identical_payload_is_not_a_304(spark):
    rows = [full("r1", "http://a.org/", 1, 'ETag: "a"')]
    rows += [("v1", "revisit", "http://a.org/", at(2), 'HTTP/1.1 200 OK\r\nETag: "a"\r\nX-New: 1\r\n\r\n', None, "k", 1)]
    rows += [("v2", "revisit", "http://a.org/", at(2), 'ETag: "a"\r\n', None, "k", 1), ("v3", "revisit", "http://b.org/", at(2), "HTTP/1.1 200 OK", None, "k", 1)]
    found = resolved(spark, rows)
    assert {k: (r.outcome, r.refers_to, r.http_status) for k, r in found.items()} == {
        "v1": ("not_304", "r1", None), "v2": ("resolved", "r1", 200), "v3": ("orphan", None, None),
    }
    assert found["v1"].headers is None and found["v1"].payload is None


def test_equal_responses_in_any_order(spark):
    rows = [full("r1", "http://a.org/", 1, f'ETag: "{tag}"', body) for tag, body in (("a", "x"), ("b", "y"), ("b", "z"))]
    asked = [again("v1", "http://a.org/", 5, 'ETag: "b"'), again("v2", "http://a.org/", 5, 'ETag: "a"')]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        found = resolved(spark, [*asked, *[rows[i] for i in order]])
        assert (found["v1"].outcome, found["v1"].payload, found["v2"].outcome) == ("resolved", "z", "changed")


def test_very_long_payload(spark):
    body = "long " * 1_000_000
    found = resolved(spark, [full("r1", "http://a.org/", 1, 'ETag: "a"', body), again("v1", "http://a.org/", 2, 'ETag: "a"')])
    assert found["v1"].payload == body


def test_urls_told_apart(spark):
    rows = [full("r1", "http://a.org:80/", 1, 'ETag: "a"'), again("v1", "https://www.a.org/", 2, 'ETag: "a"')]
    frame = spark.createDataFrame(rows, SCHEMA)
    outcome = lambda **how: warc.resolve_revisits(frame, **how).first().outcome
    assert outcome() == "resolved"
    assert outcome(scheme=True) == outcome(www=True) == outcome(ports=()) == "orphan"
