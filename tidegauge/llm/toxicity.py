"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, with exception phrases.

Folding undoes homoglyphs, accents and digits that stand for letters. The lexicon's
entries are whole words and beginnings of words with weights learned from labelled
documents; the weights found in a text are summed, normalised by its length, and turned
into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import digest_sample, fresh, quoted, stored
from tidegauge.llm.logistic import fit_logistic

# Letters of other scripts that look like Latin ones, letters that
# decompose to nothing, and signs that stand for letters inside a word.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
        "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
        "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ⅼ": "l", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae",
        "œ": "oe", "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
    }
)
STAND_INS = str.maketrans("0134578@$!|", "oieastbasil")
SIGNS = re.compile(r"[0134578@$!|]+")
# "!" and "|" at a word's end are taken for what they are.
END_SIGNS = re.compile(r"[0134578@$]+")
LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
MARKS = re.compile("[̀-ͯ]+")
NO_LETTERS = re.compile(r"[\W\d_]+")
EXCEPTIONS = ("clown fish", "clown car", "class clown", "trash can", "trash bin", "trash bag", "idiot proof")

PIECE_CHARS = 1 << 20
PREFIX_CHARS = range(4, 9)
FOUND = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND_ARROW = pa.struct([("weight", pa.float64()), ("hits", pa.int64()), ("n_words", pa.int64())])


@dataclass(frozen=True)
class ToxicitySettings:
    """Bounds of the training sample and limits of what counts as evidence; scoring has no bound."""

    per_label: int = 4000  # labelled documents of either label, those with the lowest digests
    least_documents: int = 5  # toxic documents that must hold an entry
    least_z: float = 5.0
    least_weight: float = 1.0
    seed: int = 53


def _letters(found: re.Match) -> str:
    """The letters that a run of signs stands for: between letters, before or after a word's letters."""
    run, text, begin, end = found.group(), found.string, found.start(), found.end()
    before, after = text[begin - 1 : begin], text[end : end + 1]
    if after in LOWER and (before in LOWER or not (before.isalnum() or before == "_")):
        return run.translate(STAND_INS)
    if before in LOWER and not (after.isalnum() or after == "_"):
        last = END_SIGNS.match(run)
        if last:
            # A one stands for i, but after an l at a word's end for another l.
            folded = "l" if last.group() == "1" and text[begin - 2 : begin - 1] in LOWER and before == "l" else last.group().translate(STAND_INS)
            return folded + run[last.end() :]
    return run


def fold_text(text: str) -> str:
    """Lower-case words of letters, each with a blank on both sides of it: " first second "."""
    if text.isascii():
        text = text.lower()
    else:
        # Compatible forms first: they can be capitals.
        text = MARKS.sub("", unicodedata.normalize("NFKD", text).lower().translate(LOOK_ALIKES))
    text = SIGNS.sub(_letters, text)
    return f" {NO_LETTERS.sub(' ', text).strip()} "


def pieces(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Folded parts of a text, whether the first word was counted before, and whether the last comes again.

    Parts end at blanks and share two words, so each word is once seen with both its
    neighbours; a very long text is never folded as a whole. Only a word longer than a
    part is cut.
    """
    carried: list[str] = []
    start = 0
    while True:
        stop = len(text)
        if stop - start > PIECE_CHARS:
            stop = start + PIECE_CHARS
            blank = max(text.rfind(" ", start, stop), text.rfind("\n", start, stop))
            stop = blank + 1 if blank >= start else stop
        folded = fold_text(" ".join([*carried, text[start:stop]]))
        again = stop < len(text) and bool(folded.strip())
        yield folded, len(carried) == 2, again
        if stop == len(text):
            return
        carried, start = folded.split()[-2:], stop


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words (" word ") and beginnings (" beg"), and phrases that cancel what they cover."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)
    settings: ToxicitySettings = field(default_factory=ToxicitySettings)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        made.make_automaton()
        return made

    def matches(self, text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, dict[int, float], int]]:
        """Of each part of a text: the folded part, the weight at each word that counts, and the number of words."""
        for folded, seen, again in pieces(text):
            best: dict[int, float] = {}
            covered: list[tuple[int, int]] = []
            for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
                begin = end - length + 1
                if weight is None:
                    covered.append((begin, end))
                elif weight > best.get(begin, 0.0):
                    best[begin] = weight
            n_words = folded.count(" ") - 1 if folded.strip() else 0
            first = folded.index(" ", 1) if seen else 0
            last = folded.rindex(" ", 0, len(folded) - 1) if again else len(folded)
            # The covered words: a word begins at a blank inside the phrase, its last blank excepted.
            gone = {i for b, e in covered for i in best if b <= i < e}
            counted = {i: w for i, w in best.items() if first <= i < last and i not in gone}
            yield folded, counted, n_words - (1 if seen else 0) - (1 if again else 0)

    def measure(self, text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
        """Summed weight, hits and words of a whole text."""
        weight, hits, n_words = 0.0, 0, 0
        for _, counted, words in self.matches(text or "", automaton):
            weight += sum(counted.values())
            hits += len(counted)
            n_words += words
        return weight, hits, max(0, n_words)


def inputs_of(weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the probability is made from: a constant, the weight, and the weight by length."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (n_words + 20))], axis=1)


def _sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings, id_column: str, text: str) -> DataFrame:
    """toxic, text of a bounded sample of labelled documents, as even over the labels as can be."""
    known = labels.where("toxic in (0, 1)").groupBy(F.col(quoted(id_column)).alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = stored(digest_sample(known, "toxic", settings.per_label, settings.seed, "id").select("id", "toxic"), "toxic_labels")
    # At most 2 * per_label rows.
    rows = docs.select(F.col(quoted(id_column)).alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return stored(rows.join(F.broadcast(chosen), "id").select("id", "toxic", "text"), "toxic_sample")


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, toxic, documents, rate: summed over a task's documents before anything is shuffled."""
    documents: Counter = Counter()
    rates: dict = defaultdict(float)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            words = Counter(w for folded, _, _ in pieces(text.as_py()) for w in folded.split())
            total = sum(words.values())
            own: Counter = Counter()
            for word, n in words.items():
                own[f" {word} "] += n
                for size in PREFIX_CHARS:
                    if len(word) > size:
                        own[f" {word[:size]}"] += n
            for entry, n in own.items():
                documents[entry, toxic] += 1
                rates[entry, toxic] += n / (total + 20)
    yield pa.RecordBatch.from_pydict(
        {
            "entry": pa.array([e for e, _ in documents], pa.string()),
            "toxic": pa.array([t for _, t in documents], pa.int32()),
            "documents": pa.array(list(documents.values()), pa.int64()),
            "rate": pa.array([rates[key] for key in documents], pa.float64()),
        }
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    settings: ToxicitySettings = ToxicitySettings(),
    id_column: str = "doc_id",
    text: str = "text",
) -> Lexicon:
    """Weights, exceptions and probability from labelled documents (``labels``: id, toxic 0 or 1; nulls are skipped).

    The sample is bounded (see :class:`ToxicitySettings`) and the driver gets the lexicon
    and one row of numbers per sampled document. Without labels of both kinds the
    lexicon is empty and every score is 0.
    """
    sample = _sample(docs, labels, settings, id_column, text)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(totals) != {0, 1}:
        return Lexicon({}, frozenset(), (-50.0, 0.0, 0.0), settings)
    counted = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(
        _entry_counts, "entry string, toxic int, documents bigint, rate double"
    )

    def of(label: int, column: str) -> Column:
        return F.sum(F.when(F.col("toxic") == label, F.col(column)).otherwise(0))

    entries = counted.groupBy("entry").agg(
        of(1, "documents").alias("d1"), of(0, "documents").alias("d0"), of(1, "rate").alias("r1"), of(0, "rate").alias("r0")
    )
    n1, n0 = F.lit(float(totals[1])), F.lit(float(totals[0]))
    both = (F.col("d1") + F.col("d0") + 1) / (n1 + n0 + 2)
    z = (F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    weight = F.log((F.col("r1") / n1 + 1e-5) / (F.col("r0") / n0 + 1e-5))
    best = entries.select("entry", "d1", z.alias("z"), weight.alias("weight")).where(
        (F.col("d1") >= settings.least_documents) & (F.col("z") >= settings.least_z) & (F.col("weight") >= settings.least_weight)
    )
    # No more entries than the sample's toxic documents can support.
    rows = best.collect()
    lexicon = Lexicon({r["entry"]: r["weight"] for r in rows}, frozenset(f" {e} " for e in EXCEPTIONS), settings=settings)
    lexicon = Lexicon(lexicon.weights, lexicon.exceptions | _exceptions(sample, lexicon), settings=settings)
    found = sample.select("id", "toxic", found_weights(lexicon, "text").alias("f")).select("id", "toxic", "f.*").collect()
    found.sort(key=lambda r: (r["id"], r["toxic"], r["weight"], r["n_words"]))
    x = inputs_of(np.array([r["weight"] for r in found]), np.array([r["n_words"] for r in found], float))
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_logistic(x, np.array([r["toxic"] for r in found], float)), settings)


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Two-word phrases with a lexicon word that mostly stand in documents that are not toxic."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = lexicon.automaton(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                own = set()
                for folded, counted, _ in lexicon.matches(text.as_py(), automaton):
                    for at in counted:
                        end = folded.index(" ", at + 1)
                        before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                        own |= {folded[before : end + 1]} if before >= 0 else set()
                        own |= {folded[at : after + 1]} if after >= 0 else set()
                counts.update((phrase, toxic) for phrase in own)
        yield pa.RecordBatch.from_pydict(
            {
                "phrase": pa.array([p for p, _ in counts], pa.string()),
                "toxic": pa.array([t for _, t in counts], pa.int32()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    found = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(phrases, "phrase string, toxic int, n bigint")
    per = found.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("n").alias("n"))
    harmless = per.where((F.col("clean") >= lexicon.settings.least_documents) & (F.col("clean") >= 0.95 * F.col("n")))
    return frozenset(r["phrase"] for r in harmless.select("phrase").collect())


def found_weights(lexicon: Lexicon, text: str) -> Column:
    """A struct column (weight, hits, n_words) for whole texts; zeros for null and empty ones."""

    @F.arrow_udf(FOUND)
    def measure(texts: pa.Array) -> pa.Array:
        automaton = lexicon.automaton()
        return pa.array([dict(zip(FOUND.names, lexicon.measure(t.as_py(), automaton))) for t in texts], FOUND_ARROW)

    return measure(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5), hits and weight; columns of those names are replaced.

    Null and empty texts hold no entry and get the score of a text without hits.
    """
    (found,) = fresh(docs, "_toxicity")
    made = docs.withColumn(found, found_weights(lexicon, text))
    constant, by_weight, by_length = lexicon.slopes
    weight, n_words = F.col(f"{found}.weight"), F.col(f"{found}.n_words")
    logit = constant + by_weight * F.log1p(weight) + by_length * F.log1p(100 * weight / (n_words + 20))
    probability = 1 / (1 + F.exp(-logit))
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in ("score", "predicted", "hits", "weight")]
    return made.select(
        *kept,
        probability.alias("score"),
        F.when(probability >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col(f"{found}.hits").alias("hits"),
        weight.alias("weight"),
    )
