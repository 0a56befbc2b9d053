"""Quality rules with risk-controlled cutoffs.

Each rule rejects texts whose statistic exceeds a cutoff. Cutoffs are chosen per
stratum from labelled documents: a cutoff is allowed if an exact binomial test shows
that the rule rejects at most its part of the permitted share of good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import quoted, stored
from tidegauge.llm.statistics import share, with_statistics

def rules() -> dict[str, Column]:
    """The statistics of the rules, all between 0 and 1."""
    return {
        "symbols": F.least(share("n_symbols", "word_chars"), F.lit(1.0)),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeat_words": share("n_repeat_words", "n_words"),
        "upper": F.least(share("n_upper", "word_chars"), F.lit(1.0)),
    }


@dataclass(frozen=True)
class RiskSettings:
    false_rejection: float = 0.05  # permitted share of good documents lost per stratum, over all rules
    alpha: float = 0.05  # chance that any stratum's or rule's limit is broken
    steps: int = 200  # cutoffs are multiples of 1 / steps
    least_words: int = 50
    most_repeated: int = 50  # percent of words in repeated windows


def binomial_at_most(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(X <= k) for X ~ Binomial(n, p), by summing the exact probabilities."""
    most = int(k.max(initial=0))
    i = np.arange(1, most + 1, dtype=float)
    steps = np.log((n - i + 1) / i) + np.log(p / (1 - p)) if most else np.empty(0)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    return np.minimum(1.0, np.cumsum(np.exp(logs)))[k]


def base_failed(settings: RiskSettings) -> Column:
    return (F.col("n_words") < settings.least_words) | (
        100 * F.col("n_repeat_words") > settings.most_repeated * F.col("n_words")
    )


def cutoffs(statistics: DataFrame, labels: DataFrame, settings: RiskSettings) -> DataFrame:
    """stratum, rule, step: reject beyond step / steps. Rules without an allowed cutoff have no row.

    Counts per stratum, rule and step of the labelled documents that pass the base
    rules are all that is needed, so every label is used and groups stay small. With m
    pairs of stratum and rule a test passes at alpha / m (Bonferroni); cutoffs are
    tested from the loosest down and the first failure ends the row, which needs no
    further correction. Of the allowed cutoffs the one that rejects most documents
    labelled bad is taken, the loosest of equals.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("id")).agg(F.min("quality").alias("quality"))
    held = statistics.where(~base_failed(settings)).join(known.withColumnRenamed("id", "doc_id"), "doc_id")
    step = lambda c: F.ceil(c * settings.steps).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step(c).alias("step")) for r, c in rules().items()]))
    counts = (
        held.select("stratum", "quality", each.alias("r"))
        .groupBy("stratum", "r.rule", "r.step")
        .agg(F.sum("quality").cast("bigint").alias("good"), F.sum(1 - F.col("quality")).cast("bigint").alias("bad"))
    )
    counts = stored(counts, "rule_counts")
    pairs = counts.select("stratum", "rule").distinct().count()
    n_rules, steps = len(rules()), settings.steps
    limit, level = settings.false_rejection / n_rules, settings.alpha / max(1, pairs)

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(steps + 1, np.int64), np.zeros(steps + 1, np.int64)
        np.add.at(good, own["step"], own["good"])
        np.add.at(bad, own["step"], own["bad"])
        # Rejected by cutoff s: everything in steps above s.
        lost = good.sum() - np.cumsum(good)
        caught = bad.sum() - np.cumsum(bad)
        allowed = binomial_at_most(lost, int(good.sum()), limit) <= level
        best = None
        for s in range(steps - 1, -1, -1):
            if not allowed[s]:
                break
            if caught[s] > (caught[best] if best is not None else 0):
                best = s
        rows = [] if best is None else [(own["stratum"].iloc[0], own["rule"].iloc[0], best)]
        return pd.DataFrame(rows, columns=["stratum", "rule", "step"])

    return counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, step int")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    settings: RiskSettings = RiskSettings(),
    id_column: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, failed_rules, kept.

    ``labels`` has the id and quality 1 (good) or 0; other values and nulls are skipped,
    of several labels the lowest counts. Null and empty texts have no words and fail the
    base rules. A null stratum is a stratum of its own, and a stratum with too few labels
    to prove anything has no cutoff, so it keeps all that passes the base rules. Repeated
    rows are judged alike. Other columns are ignored.
    """
    made = with_statistics(docs, id_column, text, stratum=stratum)
    statistics = stored(made.withColumn("stratum", F.coalesce(F.col("stratum"), F.lit("(null)"))), "text_statistics")
    known = labels.select(F.col(quoted(id_column)).alias("id"), F.col("quality"))
    chosen = stored(cutoffs(statistics, known, settings), "cutoffs")
    # One row per stratum.
    by_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "step"))).alias("steps"))
    joined = statistics.join(by_stratum, "stratum", "left")
    beyond = [
        F.when(F.ceil(c * settings.steps) > F.col("steps")[r], F.lit(r)) for r, c in rules().items()
    ]
    failed = F.when(F.col("steps").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(settings).alias("base_failed"), failed.alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
