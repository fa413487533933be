"""Mixing and URL filters: what the SQL comparison does not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import mixing, url_filter
from netloom.llm.url_filter import Rule


def test_mixture_meets_its_weights(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "'t' AS text", "CASE WHEN id % 6 < 4 THEN 'a' WHEN id % 6 = 4 THEN 'b' END AS source", "1 AS copy"
    )
    got = mixing.mix(docs, weights={"a": 1.0, "b": 3.0, "none": 5.0}, total=8000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 2000) < 200 and abs(n["b"] - 6000) < 300
    per = got.where("source = 'b'").groupBy("doc_id").count().collect()
    counts = np.array([r["count"] for r in per])
    zeros = 1000 - len(counts)
    mean = counts.sum() / 1000
    variance = (counts.astype(float) ** 2).sum() / 1000 - mean**2
    assert abs(variance / mean - 1) < 0.15 and zeros < 10  # a Poisson distribution of mean 6
    assert got.columns == ["doc_id", "text", "source", "copy", "rate", "order_key"]
    keys = got.groupBy(F.spark_partition_id()).agg(F.collect_list("order_key").alias("k")).collect()
    assert all(r.k == sorted(r.k) for r in keys)


def test_high_rates_and_odd_rows(spark):
    rows = [(1, "x", "rare"), (None, "y", "rare"), (None, None, None), (2, "", "big"), (2, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, weights={"rare": 1.0}, total=10000)
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert set(n) == {1, None} and all(4500 < x < 5500 for x in n.values())
    same = mixing.mix(docs, power=1.0, total=40).where("doc_id = 2").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in same)  # repeated rows draw alike
    assert mixing.mix(docs.limit(0)).count() == 0


RULES = [
    Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"),
    Rule("||ads.", "block", False), Rule("/a*z|", "block", False), Rule("banner", "block", False), Rule("|good.", "allow", False),
]


def plain(url):
    _, mark, rest = (url or "").partition("://")
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut]) if mark else ""
    path = rest[cut:].split("?")[0].split("#")[0] if mark else ""
    best = None
    for r in RULES[:4]:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    if best:
        return host, path, best.text, best.verdict
    text = (host + path).lower()
    block = text.startswith("ads.") or ".ads." in text.split("/")[0] + "." or "banner" in text or (
        "/a" in text and text.endswith("z") and text.index("/a") + 2 <= len(text) - 1)
    return host, path, None, "block" if block else "allow"


@pytest.mark.parametrize("per_pass", [50_000, 3])
def test_url_verdicts_equal_a_scan_of_all_rules(spark, per_pass):
    rng = np.random.default_rng(3)
    hosts = ["example.net", "www.Example.NET", "net", "a.net", "xnet", "example.com", "b.example.com", "example.org", "org", "ads.q.io",
             "x.ads.io", "bads.io", "good.io", "netx", "example.net:80"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/de/x?y#z", "/fr/", "?q", "#f", "/abz", "/az", "/banner.gif", "/x/banner1", "/ab", "/de"]
    urls = [f"http://{hosts[i]}{paths[j]}" for i in range(len(hosts)) for j in range(len(paths))]
    urls += [None, "", "no-scheme.net/", "a://b://net/", "http://", "http://é.NET/é", "http://net/\nx", "x" * 50000 + "://net/" + "y" * 50000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], ""), (0, urls[0], "")],
                                  "page_id bigint, url string, verdict string")
    got = url_filter.filter_urls(pages, RULES, rules_per_pass=per_pass).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    del rng


def test_rules_are_stored_under_their_rarest_token():
    assert Rule("example.net/en/", "allow").tokens == ["en", "example", "net"]
    assert Rule("||ads.", "block", False).tokens == ["ads"]
    assert Rule("a-track.x", "block", False).tokens == ["track"]
    assert Rule("a*b", "block", False).tokens == []
