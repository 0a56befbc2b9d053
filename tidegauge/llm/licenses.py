"""License texts in documents: winnowed fingerprints pick candidates, a banded alignment measures them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import quoted, text_or_empty
from tidegauge.llm.license_texts import NAMING_WORDS, TEMPLATES

# Letters in lower case, other signs as blanks: places in the text stay what they are.
PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("matched_words", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("stop", T.LongType()),
        ]
    )
)
FOUND_ARROW = pa.list_(
    pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
)


@dataclass(frozen=True)
class LicenseSettings:
    gram_words: int = 2
    window: int = 2  # fingerprints: the smallest hash of each run of this many
    short_words: int = 64  # templates up to this length keep all fingerprints
    band: int = 12  # words that may be missing or inserted, at most a fifth of the template
    least_coverage: float = 0.7


def _mixed(grams: np.ndarray) -> np.ndarray:
    """A hash of packed grams, so that the smallest is a random one."""
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash in each window; every run of ``window`` has one."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, int)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1))


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """Most words of the template found in order near the diagonal: matched, first and last place in ``words``.

    ``words`` begins ``band`` places before the template's first word is expected, so
    cell (i, d) compares template word i with word i + d, 0 <= d <= 2 * band. A match
    scores 2, a skipped word on either side costs 1; the best local score wins.
    """
    width = 2 * band + 1
    score = np.zeros(width)
    matched, first, last = np.zeros(width, int), np.full(width, -1), np.full(width, -1)
    best = (0.0, 0, -1, -1)
    padded = np.concatenate([words, np.full(max(0, len(template) + width - len(words)), -1)])
    for i, word in enumerate(template):
        here = padded[i : i + width]
        # Diagonal step, then a template word skipped (from d + 1), then words of the text skipped.
        hit = (here == word) & (here > 0)
        diagonal = np.where(hit, score + 2, score - 1)
        skipped = np.append(score[1:] - 1, -1.0)
        take = skipped > diagonal
        shift = lambda a: np.append(a[1:], a[-1])
        new = np.where(take, skipped, diagonal)
        new_matched = np.where(take, shift(matched), matched + hit)
        new_first = np.where(take, shift(first), np.where(hit & (first < 0), np.arange(i, i + width), first))
        new_last = np.where(take, shift(last), np.where(hit, np.arange(i, i + width), last))
        for d in range(1, width):
            if new[d - 1] - 1 > new[d]:
                new[d], new_matched[d], new_first[d], new_last[d] = new[d - 1] - 1, new_matched[d - 1], new_first[d - 1], new_last[d - 1]
        fresh = new <= 0
        new[fresh], new_matched[fresh], new_first[fresh], new_last[fresh] = 0, 0, -1, -1
        score, matched, first, last = new, new_matched, new_first, new_last
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (float(score[top]), int(matched[top]), int(first[top]), int(last[top]))
    return best[1:]


class LicenseIndex:
    """Templates as numbered words, and an inverted index from fingerprints to their places.

    Edits of ``k`` words leave a template of ``n`` words in ``k + 1`` unchanged runs at most. A
    short template keeps all its grams of two words, so at least n - 2 k - 1 of them are found
    again; of a longer one every run of three words keeps a fingerprint, so at least
    (n - 3 k - 2) / 2 are. As many must be found close to one diagonal, for the most edits
    that ``least_coverage`` allows: no text within them is missed, and few others are aligned.
    """

    def __init__(self, templates: dict[str, str], settings: LicenseSettings) -> None:
        self.names = list(templates)
        self.settings = settings
        self.numbers: dict[bytes, int] = {}
        texts = [text.encode().translate(PLAIN).split() for text in templates.values()]
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in text]) for text in texts]
        # What must be in the span of a match: numbers, in order where they follow each other, and naming words.
        self.needed = [self._needed(text) for text in texts]
        places, least_hits = [], []
        for t, words in enumerate(self.words):
            grams, edits = self.grams(words), int(len(words) * (1 - settings.least_coverage))
            short = len(words) <= settings.short_words
            chosen = winnow(_mixed(grams), 1 if short else settings.window)
            places += [(grams[j], t, j) for j in chosen]
            left = len(words) - 2 * edits - 1 if short else (len(words) - 3 * edits - 2) // 2
            least_hits.append(max(1, min(left, len(chosen))))
        places.sort()
        self.keys = np.array([p[0] for p in places], np.int64)
        self.places = np.array([p[1:] for p in places], np.int64).reshape(-1, 2)
        self.least_hits = np.array(least_hits, np.int64)

    def _needed(self, text: list[bytes]) -> list[list[int]]:
        runs: list[list[int]] = []
        for i, word in enumerate(text):
            if word.isdigit():
                if i and text[i - 1].isdigit():
                    runs[-1].append(self.numbers[word])
                else:
                    runs.append([self.numbers[word]])
            elif word.decode() in NAMING_WORDS:
                runs.append([self.numbers[word]])
        return [r for i, r in enumerate(runs) if r not in runs[:i]]

    def named(self, t: int, words: np.ndarray) -> bool:
        """Whether the words of a match hold what makes it this license and no other version."""
        spelled = words.tolist()
        return all(any(spelled[i : i + len(r)] == r for i in range(len(spelled) - len(r) + 1)) for r in self.needed[t])

    def band(self, t: int) -> int:
        return min(self.settings.band, max(1, len(self.words[t]) // 5))

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Runs of words packed in a number; -1 for runs with a word that no template has."""
        size, base = self.settings.gram_words, len(self.numbers) + 1
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        packed, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(size):
            packed = packed * base + words[i : i + n]
            known &= words[i : i + n] > 0
        return np.where(known, packed, -1)

    def seeds(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, diagonal) of each candidate: places with enough fingerprints within a band of diagonals."""
        grams = self.grams(words)
        low, high = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        hits = np.flatnonzero(high > low)
        n = high[hits] - low[hits]
        # Every place of every fingerprint that is found: its template, its place there, and the diagonal.
        which = np.repeat(low[hits] - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, place = self.places[which].T
        diagonal = np.repeat(hits, n) - place
        counts = np.bincount(template, minlength=len(self.words))
        for t in np.flatnonzero(counts >= self.least_hits).tolist():
            own = template == t
            yield from ((t, d) for d in self._close(diagonal[own], place[own], self.band(t), int(self.least_hits[t])))

    @staticmethod
    def _close(diagonal: np.ndarray, place: np.ndarray, band: int, least: int) -> Iterator[int]:
        """Diagonals around which ``least`` different places lie within a band."""
        order = np.argsort(diagonal, kind="stable")
        diagonal, place = diagonal[order], place[order]
        ends = np.searchsorted(diagonal, diagonal + band, "right")
        done = None
        for start in np.flatnonzero(ends - np.arange(len(ends)) >= least).tolist():
            if done is not None and diagonal[start] <= done:
                continue
            # A fingerprint that is found twice counts once.
            if len(np.unique(place[start : ends[start]])) >= least:
                middle = int(diagonal[(start + ends[start]) // 2])
                yield middle
                done = max(int(diagonal[start]), middle - band // 2)

    def find(self, data: bytes) -> list[dict]:
        """The licenses of a text that are covered well enough; of overlapping ones the longest stays."""
        plain = data.translate(PLAIN)
        get = self.numbers.get
        words = np.array([get(w, 0) for w in plain.split()], np.int64)
        found = []
        for t, diagonal in self.seeds(words):
            template, band = self.words[t], self.band(t)
            begin = diagonal - band
            part = words[max(0, begin) : diagonal + len(template) + band]
            if begin < 0:
                part = np.concatenate([np.full(-begin, -1), part])
            if not self.named(t, part):
                continue
            matched, first, last = align(template, part, band)
            enough = matched >= self.settings.least_coverage * len(template)
            if enough and self.named(t, words[begin + first : begin + last + 1]):
                found.append((matched, begin + first, begin + last, t))
        if not found:
            return []
        spans = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
        kept: list[tuple[int, int, int, int]] = []
        ends: dict[int, int] = {}
        for one in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
            if all(i not in ends for i in (one[1], one[2], (one[1] + one[2]) // 2)):
                kept.append(one)
                ends |= dict.fromkeys(range(one[1], one[2] + 1), 1)
        return [
            {
                "license": self.names[t],
                "coverage": matched / len(self.words[t]),
                "matched_words": matched,
                "start": len(data[: spans[first][0]].decode("utf-8", "replace")),
                "stop": len(data[: spans[last][1]].decode("utf-8", "replace")),
            }
            for matched, first, last, t in sorted(kept, key=lambda f: f[1])
        ]


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    settings: LicenseSettings = LicenseSettings(),
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per license found: doc_id, license, coverage, matched_words, start, stop.

    ``coverage`` is the share of the template's words found in order; ``start`` and
    ``stop`` count characters of the whole text. Case, punctuation and line breaks do
    not matter. A match must hold the numbers and naming words of its template, so another
    version or variant is not taken for it. Texts without a license, null and empty texts have no row. Repeated rows
    repeat their findings. Other columns are ignored. The templates are fixed and small,
    so each task holds their index; nothing is shuffled.
    """
    chosen = TEMPLATES if templates is None else templates

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        index = LicenseIndex(chosen, settings)
        return pa.array([index.find(t.as_py()) for t in texts], FOUND_ARROW)

    rows = docs.select(F.col(quoted(id_column)).alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return rows.select("doc_id", F.explode(find("text")).alias("f")).select("doc_id", "f.*")
