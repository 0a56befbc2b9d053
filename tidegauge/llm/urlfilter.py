"""URL filters: rules for hosts and paths, and boosted trees on lexical features for what no rule names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import boosting
from tidegauge.llm.boosting import Boosted, BoostSettings
from tidegauge.llm.common import digest_sample, quoted, stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlSettings:
    per_verdict: int = 5000  # bound of the labelled URLs the trees are fitted on, for each verdict
    smoothing: float = 20.0  # labelled URLs that a suffix needs to count for half
    threshold: float = 0.5
    folds: int = 5  # a URL is fitted with the suffix statistics of the other folds
    seed: int = 53
    boost: BoostSettings = field(default_factory=BoostSettings)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as given; empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The place in ``rules`` of the longest that fits (ties: the longer host, then block); null for none."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host), rules[i].verdict != BLOCK))
    chosen = F.lit(None).cast("int")
    for i in reversed(order):
        rule = rules[i]
        own = (host == rule.host) | host.endswith("." + rule.host)
        chosen = F.when(own & path.startswith(rule.path), F.lit(i)).otherwise(chosen)
    return chosen


def _of(rules: Sequence[Rule], place: Column, what: Callable[[Rule], str | int]) -> Column:
    """What the rule at a place says; null for no place."""
    said = F.lit(None)
    for i, rule in enumerate(rules):
        said = F.when(place == i, F.lit(what(rule))).otherwise(said)
    return said


# --- features -------------------------------------------------------------

FEATURES = (
    "length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "hyphens", "longest_label", "longest_segment", "capitals", "escapes",
    "suffix_rate", "suffix_known", "domain_rate", "domain_known", "ending_rate", "ending_known", "opening_rate", "opening_known",
)
#: What statistics are kept of: the host's last label, its last two, the ending of the path's last segment, and its first segment.
SUFFIXES = ("suffix", "domain", "ending", "opening")
N_LEXICAL = len(FEATURES) - 2 * len(SUFFIXES)


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {
        "suffix": F.regexp_extract(host, r"[^.]*$", 0),
        "domain": F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?$", 0),
        "ending": F.regexp_extract(path, r"\.[A-Za-z0-9]{1,8}$", 0),
        "opening": F.regexp_extract(path, r"^/([^/]*)", 1),
    }


def _entropy(data: np.ndarray) -> float:
    counts = np.bincount(data)
    share = counts[counts > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum()) if len(data) else 0.0


def _digits(data: np.ndarray) -> float:
    return float(((data >= 0x30) & (data <= 0x39)).mean()) if len(data) else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of one URL that need no statistics; linear in its length."""
    whole, name = np.frombuffer(url.encode(), np.uint8), np.frombuffer(host.encode(), np.uint8)
    query = url.partition("#")[0].partition("?")[2]
    segments, labels = [s for s in path.split("/") if s], host.split(".")
    return [
        len(url), len(host), len(path), len(query), host.count(".") + 1 if host else 0, len(segments),
        _digits(whole), _digits(name), _entropy(whole), _entropy(name),
        sum(1 for p in query.replace(";", "&").split("&") if p), host.count("-"),
        max(map(len, labels)), max(map(len, segments), default=0),
        float(((whole >= 0x41) & (whole <= 0x5A)).sum()), url.count("%"),
    ]


def lexical_features(url: Column, host: Column, path: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measure(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rows = [lexical(u.as_py(), h.as_py(), p.as_py()) for u, h, p in zip(urls, hosts, paths)]
        return pa.array(rows, pa.list_(pa.float64()))

    return measure(F.coalesce(url, F.lit("")), host, path)


# --- training and scoring -------------------------------------------------


@dataclass(frozen=True)
class UrlModel:
    """Trees, the share of blocked URLs, and per kind of suffix a table: value, n, blocked (sums over all labelled URLs)."""

    trees: Boosted
    share: float
    statistics: dict[str, DataFrame]
    settings: UrlSettings


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` (with url) with host, path and the values that statistics are kept of."""
    host, path = host_and_path(F.col("url"))
    made = rows.withColumns({"host": host, "path": path})
    return made.withColumns(suffixes(F.col("host"), F.col("path")))


def _features(rows: DataFrame, statistics: dict[str, DataFrame], share: float, settings: UrlSettings, own: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rows`` of ``_parts`` with an array of statistics and one of lexical features.

    ``own`` holds the part of the statistics that comes from the fold of a row itself, to be
    taken out: taking out the row's own label alone would give that label away.
    """
    values = []
    for kind, table in statistics.items():
        rows = rows.join(table.toDF(kind, f"{kind}_n", f"{kind}_blocked"), kind, "left")
        n, blocked = (F.coalesce(F.col(f"{kind}_{c}"), F.lit(0)) for c in ("n", "blocked"))
        if own is not None:
            rows = rows.join(own[kind].toDF(kind, "fold", f"{kind}_own_n", f"{kind}_own_blocked"), [kind, "fold"], "left")
            n, blocked = n - F.coalesce(F.col(f"{kind}_own_n"), F.lit(0)), blocked - F.coalesce(F.col(f"{kind}_own_blocked"), F.lit(0))
        values += [(blocked + settings.smoothing * share) / (n + settings.smoothing), F.log1p(n)]
    return rows.withColumn("statistics", F.array(*[v.cast("double") for v in values])).withColumn(
        "lexical", lexical_features(F.col("url"), F.col("host"), F.col("path"))
    )


def _matrix(*columns: pa.Array) -> np.ndarray:
    """The numbers of list columns side by side."""
    widths = (N_LEXICAL, 2 * len(SUFFIXES))
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for c, w in zip(columns, widths)], axis=1)


def train(labelled: DataFrame, settings: UrlSettings = UrlSettings()) -> UrlModel:
    """Statistics of all labelled URLs (columns url, blocked: 0 or 1) and trees fitted on a bounded sample.

    Null URLs and labels are skipped. A URL given several times is one URL with so many
    labels. Without labels nothing is blocked; with one kind of label the trees are
    left out.
    """
    known = labelled.where("url is not null and blocked in (0, 1)").groupBy("url", F.col("blocked").cast("int").alias("blocked"))
    known = _parts(known.agg(F.count(F.lit(1)).alias("n")))
    known = stored(known.withColumn("fold", F.pmod(F.xxhash64(F.lit(settings.seed), "url"), F.lit(settings.folds))), "labelled_urls")
    sums = F.sum("n").alias("n"), F.sum(F.col("n") * F.col("blocked")).alias("blocked")
    total = known.agg(*sums).first()
    share = total["blocked"] / total["n"] if total["n"] else 0.0
    own = {kind: stored(known.groupBy(kind, "fold").agg(*sums), f"{kind}_urls") for kind in SUFFIXES}
    statistics = {kind: table.groupBy(kind).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")) for kind, table in own.items()}
    sample = stored(digest_sample(known, "blocked", settings.per_verdict, settings.seed, "url"), "sampled_urls")
    found = _features(sample, statistics, share, settings, own)
    # At most 2 * per_verdict rows of numbers.
    rows = sorted(found.select("url", "blocked", "lexical", "statistics").collect())
    x = np.array([r["lexical"] + r["statistics"] for r in rows]).reshape(-1, len(FEATURES))
    return UrlModel(boosting.fit(x, np.array([r["blocked"] for r in rows], float), settings.boost), share, statistics, settings)


def score(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (with a column url; null counts as empty) with host, path and ``score``: how likely it is one to block."""
    trees = model.trees

    @F.arrow_udf("double")
    def probability(measured: pa.Array, statistics: pa.Array) -> pa.Array:
        return pa.array(trees.probability(_matrix(measured, statistics)), pa.float64())

    found = _features(_parts(urls), model.statistics, model.share, model.settings)
    scored = found.withColumn("score", probability("lexical", "statistics"))
    return scored.select(*[F.col(quoted(c)) for c in urls.columns if c not in ("host", "path", "score")], "host", "path", "score")


def labelled_by(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """url, blocked: the URLs that a rule fits, with its verdict."""
    text = F.col(quoted(url)).cast("string")
    place = longest_rule(rules, *host_and_path(text))
    return pages.select(text.alias("url"), _of(rules, place, lambda r: int(r.verdict == BLOCK)).alias("blocked")).where("blocked is not null")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], model: UrlModel, id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the verdict of the longest rule that fits, else that of the trees.

    A null URL and one without ``://`` have an empty host and path, fit no rule and are
    judged by the trees. Every row has a verdict, repeated ones and those without an id
    too; an empty table has none. Other columns are ignored. The rules stand in the plan
    as one condition each, so they are a list of some hundreds at most.
    """
    rows = pages.select(F.col(quoted(id_column)).alias("page_id"), F.col(quoted(url)).cast("string").alias("url"))
    found = score(rows, model).withColumn("place", longest_rule(rules, F.col("host"), F.col("path")))
    text, verdict = _of(rules, F.col("place"), lambda r: r.text), _of(rules, F.col("place"), lambda r: r.verdict)
    judged = F.when(F.col("score") >= model.settings.threshold, BLOCK).otherwise(ALLOW)
    return found.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "score")
