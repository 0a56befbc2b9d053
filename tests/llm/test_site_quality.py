"""Op 4: shrinkage toward host and corpus, and agreement with labels."""

from pyspark.sql import functions as F

from tidegauge.llm import queries
from tidegauge.llm.site_quality import SiteSettings, classify, host_of, path_of

SF_DIR = "/root/testdata/sf0.01"


def test_addresses(spark):
    rows = [("https://www.Host.example.com:80/en/12?x=1",), ("http://u@h.org",), ("nothing",), (None,)]
    urls = spark.createDataFrame(rows, "url string")
    found = urls.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert [tuple(r) for r in found] == [("host.example.com", "en"), ("h.org", ""), (None, ""), (None, None)]


def test_sites_are_shrunk(spark):
    """Equal texts: a bad site's documents fall, a site with little record stays near the corpus."""
    rows, labels = [], []
    for i in range(600):
        host = "good" if i < 300 else "bad" if i < 598 else "sparse"
        rows.append((i, "the same words on every page", host, "p"))
        if i % 2 == 0 and host != "sparse":
            labels.append((i, int(host == "good")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = {r.doc_id: r for r in classify(docs, known).collect()}
    assert found[1].posterior > 0.7 and found[1].kept
    assert found[301].posterior < 0.3 and not found[301].kept
    assert found[301].posterior < found[599].posterior < found[1].posterior
    assert found[599].host_posterior < found[1].host_posterior


def test_agreement_with_labels(spark):
    found = queries.op4_site_quality(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in found) / len(found) > 0.97


def test_odd_rows(odd_documents, no_documents, no_labels):
    rows = classify(odd_documents, no_labels, host="source", path="lang").collect()
    assert len(rows) == odd_documents.count() and {r.evidence for r in rows} == {0.0}
    known = odd_documents.selectExpr("doc_id", "CAST(coalesce(doc_id % 2, 1) AS INT) AS quality")
    assert len(classify(odd_documents, known, host="source", path="lang").collect()) == odd_documents.count()
    assert classify(no_documents, no_labels, host="source", path="lang").collect() == []


def test_agreement_on_labels_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    found = classify(docs, labels.where(~held_out), host="source", path="lang").join(labels.where(held_out), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in found)
    assert len(found) > 500 and right / len(found) > max(0.95, sum(r.quality for r in found) / len(found))


def test_posteriors_against_their_definition(spark):
    """Votes, hosts, paths and leave-one-out posteriors summed in plain Python; one fixed strength."""
    from math import exp, log

    chosen = SiteSettings(least_strength=7.0, most_strength=7.0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("doc_id % 3 > 0")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = classify(docs, labels, chosen, host="source", path="lang").collect()
    base = min(max(sum(known.values()) / len(known), 1e-3), 1 - 1e-3)
    sigmoid = lambda x: 1 / (1 + exp(-x))
    votes = {}
    for r in rows:
        weight = 1.0 if r.doc_id in known else chosen.vote_weight
        votes[r.doc_id] = weight, weight * (known[r.doc_id] if r.doc_id in known else sigmoid(r.evidence + log(base / (1 - base))))
    total = lambda keep: [sum(votes[r.doc_id][i] for r in rows if keep(r)) for i in (0, 1)]
    n, good = total(lambda r: True)
    shrunk = lambda good, n, prior: (7.0 * prior + good) / (7.0 + n)
    for r in rows:
        (host_n, host_good), (path_n, path_good) = total(lambda q: q.host == r.host), total(lambda q: (q.host, q.path) == (r.host, r.path))
        host = shrunk(host_good, host_n, good / n)
        assert abs(r.host_posterior - host) < 1e-9 and abs(r.path_posterior - shrunk(path_good, path_n, host)) < 1e-9
        weight, vote = votes[r.doc_id]
        alone = shrunk(path_good - vote, path_n - weight, shrunk(host_good - vote, host_n - weight, good / n))
        assert abs(r.posterior - sigmoid(r.evidence + log(alone / (1 - alone)))) < 1e-9
