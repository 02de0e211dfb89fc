"""URL rules against brute force; the regression by accuracy on addresses it has not seen."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import url_filter


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(spark)


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


ODD = [
    None, "", "://", "no scheme", "http://", "HTTPS://WWW.Example.ORG/en/1x?q#f", "https://example.org/en/2", "http://xexample.org/es/", "http://a.example.org/es/", "http://org/", "http://org", "http://é.Ünï.com/fr/",
    "http://com/de/", "http://x.com/de", "a://b://c/d", "http://h?x/y", "http://h#x/y", "http://x.example.org/es/\nrest", "http://x.org?/es/", "http://y.net/" + "p" * 20000, "x" * 50000,
]


def test_rules_match_brute_force(spark, model, sf):
    urls = ODD + [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.org/", "h"), (1, "", "h")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(pages, model=model).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        if r.page_id is not None:
            host, path, rule, verdict = brute(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
            assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
    assert url_filter.judge_urls(pages.where("false"), model=model).count() == 0
    assert url_filter.judge_urls(pages, rules=(), model=model).where("rule is not null").count() == 0


def test_probability_is_the_weighted_sum(spark, model):
    weights, intercept = model
    rows = spark.createDataFrame([("a.example.net", "/b/c"), ("", "")], "h string, p string").select(url_filter.grams(F.col("h"), F.col("p")).alias("g"))
    rows = rows.select("g", url_filter.probability(F.col("g"), weights, intercept).alias("p")).collect()
    for r in rows:
        z = sum(weights[g] for g in r.g) / math.sqrt(len(r.g)) + intercept if r.g else intercept
        assert abs(r.p - 1 / (1 + math.exp(-z))) < 1e-9
    text = ["h^a.example.net$", "p^/b/c$"]
    most = sum(len({t[i : i + n] for i in range(len(t) - n + 1)}) for t in text for n in url_filter.SIZES)
    assert most - 3 <= len(rows[0].g) <= most


def test_unseen_hosts(spark):
    """Three folds by whole hosts: no host of a fold is in the table that its model learns from."""
    from gaugeframe.llm.url_examples import examples

    site = lambda url: re.sub(r"^\w+://(?:www\.|m\.)?", "", url).split(".example.")[0].split(".")[-1]
    fold = {u: sum(site(u).encode()) % 3 for u, _ in examples()}
    right = {0: [], 1: []}
    for k in range(3):
        known = spark.createDataFrame([x for x in examples() if fold[x[0]] != k], "url string, label int")
        fresh = [x for x in examples() if fold[x[0]] == k]
        assert not {site(u) for u, _ in fresh} & {site(u) for u, _ in examples() if fold[u] != k}
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
        for r in url_filter.judge_urls(pages, rules=(), model=url_filter.train(spark, known)).collect():
            label = fresh[r.page_id][1]
            right[label].append((r.verdict == "block") == label)
    assert sum(right[1]) / len(right[1]) > 0.5 and sum(right[0]) / len(right[0]) > 0.9, {k: sum(v) / len(v) for k, v in right.items()}


def test_labels_of_one_kind_or_none(spark):
    table = spark.createDataFrame([("http://a.b/c", 1), (None, None)], "url string, label int")
    assert url_filter.train(spark, table) == ([0.0] * url_filter.BINS, 5.0)
    assert url_filter.train(spark, table.where("false"))[1] == 0.0
