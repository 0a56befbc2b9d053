"""Op 13: hosts, paths and rules against brute force; the trees on URLs they have not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import boosting, queries, urlfilter
from tidegauge.llm.urlfilter import Rule, filter_urls, labelled_by, train

LOWER = str.maketrans(urlfilter.CAPITALS, urlfilter.SMALL)
RULES = queries.URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def ruled(url, rules=RULES):
    host, path = split(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


URLS = [
    "https://example.org/es/1", "http://www.Example.ORG/en/12?x=/es/", "https://notexample.org/es/1", "https://example.org/en/2",
    "https://example.org", "https://example.org?x=1", "https://a.com/fr/", "https://a.com/FR/", "https://com/de/x#y", "xcom/de/",
    "https://com.net/de/", "ftp://org//", "://org/x", "", None, "https://é.org/ü?ß", "a://b://c.org/x", "https://x.org:80/es/", "org/",
    "https://a.org/\n/x", "https://ex\nample.org/es/",
]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_by(queries.table(spark, "/root/testdata/sf0.01", "pages"), RULES))


def test_hosts_paths_and_rules(spark, model):
    found = filter_urls(pages(spark, URLS), RULES, model).collect()
    assert len(found) == len(URLS)
    for r in found:
        rule = ruled(URLS[r.page_id])
        assert (r.host, r.path) == split(URLS[r.page_id])
        assert r.rule == (rule.text if rule else None) and 0 <= r.score <= 1
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")


def test_the_longest_rule_wins(spark, model):
    rules = [Rule("allow", "b.org", "/"), Rule("block", "org", "/ab"), Rule("allow", "org", "/ab"), Rule("block", "a.b.org", "/")]
    urls = ["x://a.b.org/ab", "x://b.org/ab", "x://b.org/", "x://c.org/ab", "x://c.org/", "x://z.a.b.org/q"]
    found = {r.page_id: r for r in filter_urls(pages(spark, urls), rules, model).collect()}
    for i, url in enumerate(urls):
        rule = ruled(url, rules)
        assert found[i].rule == (rule.text if rule else None) and (rule is None or found[i].verdict == rule.verdict)


def test_query_on_a_table(spark):
    urls = {r.page_id: r.url for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    found = queries.op13_url_filter(spark, "/root/testdata/sf0.01").collect()
    again = queries.op13_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert sorted(found) == sorted(again) and {r.page_id for r in found} == set(urls)
    for r in found:
        rule = ruled(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule.text if rule else None)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)


def test_accuracy_on_held_out_urls(spark):
    """URLs whose label follows their shape and their host's suffix, some at random."""
    number = F.col("id")
    junk = F.concat(F.lit("http://"), F.substring(F.sha2(number.cast("string"), 256), 1, 14), F.lit(".win/"), F.md5(number.cast("string")), F.lit("?a=1&b="), number)
    tidy = F.concat(F.lit("https://www.site"), number % 40, F.lit(".org/en/page-"), number % 97)
    mixed = F.concat(F.lit("https://www.site"), number % 40, F.lit(".info/"), F.when(number % 2 == 0, F.md5(number.cast("string"))).otherwise("about"))
    rows = spark.range(3000).select(
        F.when(number % 3 == 0, junk).when(number % 3 == 1, tidy).otherwise(mixed).alias("url"),
        F.when(number % 3 == 2, number % 2 == 0).otherwise(number % 3 == 0).cast("int").alias("blocked"),
    )
    held_out = F.crc32("url") % 4 == 0
    model = train(rows.where(~held_out))
    scored = urlfilter.score(rows.where(held_out), model).collect()
    right = [(r.score >= 0.5) == (r.blocked == 1) for r in scored]
    assert len(right) > 500 and np.mean(right) > 0.97


def test_query_model_on_held_out_urls(spark):
    known = labelled_by(queries.table(spark, "/root/testdata/sf0.1", "pages"), RULES)
    held_out = F.crc32("url") % 4 == 0
    scored = urlfilter.score(known.where(held_out), train(known.where(~held_out))).collect()
    right = np.mean([(r.score >= 0.5) == (r.blocked == 1) for r in scored])
    assert len(scored) > 200 and right > 0.9


def test_boosting_follows_its_labels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    fitted = boosting.fit(x[:1500], y[:1500])
    assert ((fitted.probability(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95
    assert boosting.fit(x, np.ones(2000)).probability(x[:3]).min() > 0.99
    assert boosting.fit(x[:0], y[:0]).probability(x[:3]).max() < 0.01


def test_odd_rows(spark):
    long = "https://h" + "a.b" * 50000 + "/" + "x/" * 50000 + "?" + "p=1&" * 50000
    rows = [(1, long, 1), (1, long, 1), (None, "https://a.org/", 0), (2, None, 1), (3, "", None), (4, "https://b.com/de/", 7)]
    labelled = spark.createDataFrame(rows, "page_id bigint, url string, blocked int")
    odd = labelled.selectExpr("*", "1 AS host", "2 AS path", "3 AS score", "4 AS rule", "5 AS suffix", "6 AS n", "7 AS `a.b`")
    model = train(odd)
    found = filter_urls(odd, RULES, model).collect()
    assert len(found) == 6 and {r.verdict for r in found} <= {"allow", "block"}
    assert filter_urls(odd.where("false"), RULES, model).collect() == []
    empty = train(odd.where("false"))
    assert [(r.page_id, r.rule) for r in filter_urls(odd, RULES, empty).collect() if r.verdict == "block"] == [(4, "com/de/")]
