"""Quality by hierarchical empirical Bayes: a document's own evidence and the record of its site.

A logistic classifier on counts of the text gives each document's evidence. Every
document then votes for its path with what is known of it: its label, or else the
classifier's probability. Paths are shrunk toward their host and hosts toward the
whole corpus, the more the less there is of them; how strongly is estimated from how
much hosts and paths differ. A document's posterior adds its own evidence to the
record of the other documents of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import digest_sample, quoted, stored
from tidegauge.llm.logistic import fit_logistic
from tidegauge.llm.statistics import share, with_statistics


@dataclass(frozen=True)
class SiteSettings:
    """``per_label`` bounds the rows the classifier is fitted on; nothing else is bounded."""

    per_label: int = 5000
    vote_weight: float = 0.5  # of a document without a label, against 1 of a labelled one
    least_strength: float = 2.0  # bounds of the estimated prior strengths, in documents
    most_strength: float = 1e6
    threshold: float = 0.5
    seed: int = 61


def inputs() -> list[Column]:
    """What the classifier sees of a text."""
    symbols, upper = share("n_symbols", "word_chars"), share("n_upper", "word_chars")
    return [
        F.lit(1.0),
        F.log1p(100 * symbols),
        F.log1p(100 * upper),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
        1 - share("n_distinct_words", "n_words"),
        F.log1p(share("word_chars", "n_words")),
        F.log1p("n_words") / 10,
    ]


def host_of(url: Column) -> Column:
    """The host of an address, lower-case, without a leading "www."; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", F.regexp_replace(found, "^www[.]", ""))


def path_of(url: Column) -> Column:
    """The first step of an address's path; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*/([^/?#]*)", 1)


def _known(labels: DataFrame, id_column: str) -> DataFrame:
    valid = labels.where("quality in (0, 1)")
    return valid.groupBy(F.col(quoted(id_column)).alias("doc_id")).agg(F.min("quality").alias("quality"))


def fit_evidence(statistics: DataFrame, labels: DataFrame, settings: SiteSettings) -> tuple[float, ...]:
    """Slopes of the classifier, less the log odds of the sample's labels; zeros without both labels."""
    chosen = digest_sample(labels, "quality", settings.per_label, settings.seed, "doc_id")
    rows = statistics.join(chosen, "doc_id").select("doc_id", "quality", F.array(*inputs()).alias("x")).distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), len(inputs())), np.array([r["quality"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return (0.0,) * len(inputs())
    slopes = np.array(fit_logistic(x, y))
    slopes[0] -= np.log(y.sum() / (len(y) - y.sum()))
    return tuple(map(float, slopes))


def _strength(groups: DataFrame, parent: Column, settings: SiteSettings) -> float:
    """The strength of a beta prior around ``parent``, by the method of moments.

    If a group's mean differs from its parent's by more than chance, the rest is true
    variation: v = m (1 - m) / (1 + strength). One row of sums reaches the driver.
    """
    mean = F.col("good") / F.col("n")
    chance = parent * (1 - parent)
    row = groups.where("n > 1").agg(
        F.sum((mean - parent) ** 2 * F.col("n")).alias("seen"),
        F.sum(chance).alias("chance"),
        F.sum(chance * F.col("n")).alias("whole"),
    ).first()
    # E(seen) = chance + v (n - 1), summed over the groups, with v = chance * rho.
    if not row["whole"] or row["whole"] <= row["chance"]:
        return settings.most_strength
    rho = (row["seen"] - row["chance"]) / (row["whole"] - row["chance"])
    strength = (1 - rho) / rho if rho > 0 else settings.most_strength
    return float(min(settings.most_strength, max(settings.least_strength, strength)))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    settings: SiteSettings = SiteSettings(),
    id_column: str = "doc_id",
    text: str = "text",
    host: str = "host",
    path: str = "path",
) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, posterior, kept.

    ``labels`` has the id and quality 1 (good) or 0; other values and nulls are skipped,
    of several labels the lowest counts. ``evidence`` is the log odds of the text alone.
    The posteriors of host and path are those of all their documents; the document's own
    posterior leaves its own vote out. Null hosts and paths count as empty ones, null
    texts as empty; without labels all evidence is 0. Repeated rows vote each. Other
    columns are ignored.
    """
    rows = with_statistics(docs, id_column, text, host=host, path=path)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")})
    rows = stored(rows, "site_statistics")
    known = stored(_known(labels, id_column), "quality_labels")
    slopes = fit_evidence(rows, known, settings)
    # The sample was even over the labels; the corpus is as its labels are.
    evidence = sum((slope * x for slope, x in zip(slopes, inputs())), F.lit(0.0))
    share_good = known.agg(F.avg("quality")).first()[0]
    base = float(np.clip(share_good if share_good is not None else 0.5, 1e-3, 1 - 1e-3))
    alone = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))
    voted = rows.join(known, "doc_id", "left").withColumn("evidence", evidence)
    voted = voted.withColumns(
        {
            "weight": F.when(F.col("quality").isNotNull(), 1.0).otherwise(settings.vote_weight),
            "vote": F.coalesce(F.col("quality").cast("double"), alone),
        }
    )
    voted = stored(voted.select("doc_id", "host", "path", "evidence", "weight", (F.col("weight") * F.col("vote")).alias("good")), "votes")

    paths = stored(voted.groupBy("host", "path").agg(F.sum("good").alias("good"), F.sum("weight").alias("n")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")), "hosts")
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    mean = F.lit(float(total["good"] / total["n"]) if total["n"] else base)
    by_host = _strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), mean, settings)
    both = paths.join(hosts, "host").withColumn("host_mean", F.col("host_good") / F.col("host_n"))
    by_path = _strength(both, F.col("host_mean"), settings)

    def shrunk(good: Column, n: Column, prior: Column, strength: float) -> Column:
        return (strength * prior + good) / (strength + n)

    host_posterior = shrunk(F.col("host_good"), F.col("host_n"), mean, by_host)
    sites = both.withColumn("host_posterior", host_posterior).withColumn(
        "path_posterior", shrunk(F.col("good"), F.col("n"), F.col("host_posterior"), by_path)
    )
    sites = stored(
        sites.select("host", "path", "host_good", "host_n", F.col("good").alias("path_good"), F.col("n").alias("path_n"), "host_posterior", "path_posterior"),
        "sites",
    )
    judged = voted.join(sites, ["host", "path"])
    # The site's record without the document's own vote.
    own_host = shrunk(F.col("host_good") - F.col("good"), F.col("host_n") - F.col("weight"), mean, by_host)
    own_path = shrunk(F.col("path_good") - F.col("good"), F.col("path_n") - F.col("weight"), own_host, by_path)
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(own_path))))
    return judged.select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", posterior.alias("posterior")
    ).withColumn("kept", F.col("posterior") >= settings.threshold)
