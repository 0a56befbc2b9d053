"""The queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    ann, bpe, langid, lexical, licenses, mixing, quality_rules, secretscan, simhash, site_quality, toxicity, urlfilter, vectorcodes,
)
from tidegauge.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_amounts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("failed_rules", F.array_join("failed_rules", ","))


TOXICITY_FOLDS, TOXICITY_HELD_OUT = 5, 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(fold("doc_id", TOXICITY_FOLDS) != TOXICITY_HELD_OUT))
    found = toxicity.score(docs.select("doc_id", "text"), lexicon)
    held_out = F.coalesce(fold("doc_id", TOXICITY_FOLDS) == TOXICITY_HELD_OUT, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits")


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host, its language in that source the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality.classify(docs, labels, host="source", path="lang")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Fitted on the documents outside the held-out fold."""
    return langid.train(docs.where(fold("doc_id", LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.coalesce(fold("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of their decoding."""
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), columns=["doc_id"])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every document; a document's source stands for its path."""
    forest = secretscan.train(secretscan.labelled_findings(spark))
    return secretscan.scan(table(spark, sf_dir, "documents"), forest, path="source")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# The rules of the query.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a rule names teach the trees what to do with the others."""
    pages = table(spark, sf_dir, "pages")
    model = urlfilter.train(urlfilter.labelled_by(pages, URL_RULES))
    return urlfilter.filter_urls(pages, URL_RULES, model)


ALL: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_site_quality": op4_site_quality,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_bpe": op8_bpe,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_url_filter": op13_url_filter,
}
